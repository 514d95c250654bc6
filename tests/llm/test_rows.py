"""Rows without an id, and ids that come again with other texts: every row is judged by itself."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from loglattice.llm import ngram_jaccard_join, sharding

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORDS = [f"w{i}" for i in range(60)]


def cut(a, b):
    return " ".join(WORDS[a:b])


A, B, C = cut(0, 50), cut(3, 53), cut(6, 56)  # A-B and B-C link (43 of 49 shingles), A-C does not (40 of 52)


def brute(rows):
    """Component per row, from all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[root(i)] = min(doc, least.get(root(i), doc))
    own = [(least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
    shared = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            shared[doc] = min(own[i], shared.get(doc, own[i]))
    return sorted(((doc, len(sets[i]), shared.get(doc, own[i]) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (None, B), (3, C)],  # a link through a row without id
        [(5, A), (2, "q " + cut(30, 60)), (2, B), (2, "z y x w v u"), (9, C)],  # an id with three texts
        [(None, A), (None, B), (None, A), (4, "other words of no kin at all")],
        [(None, ""), (7, None), (7, A), (None, C.upper()), (8, B)],
    ],
)
def test_no_link_is_lost(docs_of, rows):
    assert sorted(map(tuple, ngram_jaccard_join.grouped(docs_of(rows)).collect()), key=str) == brute(rows)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_near_copies_without_ids(spark, folder, docs_of):
    docs = docs_of([(1, A), (None, A), (None, B), (None, B), (None, "a text of its own that nobody else has"), (6, "  "), (None, None), (6, "  ")])
    kept = stage("near_dedup")(spark, docs, folder)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, A), (None, "a text of its own that nobody else has"), (6, "  "), (None, None), (6, "  ")], key=str)


def test_leaks_take_no_other_row_along(spark, folder, docs_of):
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    docs = docs_of([(None, f"before {leak} after"), (None, A), (3, leak), (3, B), (None, None), (3, B)])
    kept = stage("decontamination")(spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, A), (3, B), (3, B), (None, None)], key=str)


def test_stages_on_awkward_tables(spark, folder, awkward):
    wide = awkward.selectExpr("*", "1 AS name", "2 AS root", "3 AS _id", "'x' AS score")
    for name, function in corpus_pipeline.STAGES:
        if name == "language_id":
            continue  # its table must hold several languages; see the tests of the operator
        assert function(spark, wide.limit(0), folder).count() == 0
        found = function(spark, wide, folder)
        assert found.count() > 0 and (name == "packing" or found.columns == wide.columns)


def test_shards_of_copies_weigh_the_same(docs_of):
    copies = docs_of([(None, "one and the same text of some length")] * 300 + [(5, "other")] * 100)
    weights = {}
    rows = sharding.sharded(copies, 4).collect()
    for r in rows:
        weights.setdefault(r.shard, []).append((r.size, r.slot))
    total = sum(r.size for r in rows)
    assert len(weights) == 4 and max(abs(sum(s for s, _ in w) - total / 4) for w in weights.values()) <= 60
    same = sharding.sharded(docs_of([(1, "t" * 30)] * 400), 40).collect()
    assert {s: sum(r.shard == s for r in same) for s in range(40)} == dict.fromkeys(range(40), 10)
    for s in range(40):
        assert sorted(r.slot for r in same if r.shard == s) == list(range(10))


def test_workers_need_no_copy_of_the_package(tmp_path, folder):
    """The driver alone has the repository on its path; workers start in another folder."""
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
from loglattice.session import build_session
spark = build_session("bare", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
import __spark_entry__ as entry
names = [q for q in entry.queries() if q.split("_")[0] in ("op7", "op10", "op12", "op13", "op5")]
for name in names:
    assert entry.queries()[name](spark, {folder!r}).count() >= 0
print("ran", len(names))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ran 5" in out.stdout, out.stderr[-2000:]
