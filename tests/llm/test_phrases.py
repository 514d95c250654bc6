"""Phrase mining and its index against counting by hand."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loglattice.llm.phrase_mining import WordIndex, collocations, joined, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, word string, n long, words int"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces_of(text):
    parts = re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))
    return [[w for w in re.split("[ \t]+", p) if w] for p in parts]


def brute(rows, longest, least, best):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        held = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= f[q[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in held:
                cuts = [(1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_index_extends_on_both_sides(seed):
    rng = np.random.default_rng(seed)
    depth, kinds = int(rng.integers(2, 7)), int(rng.integers(1, 6))
    text = np.concatenate([[0], rng.integers(0, kinds + 1, 60), [0]])
    index = WordIndex(text, depth)
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    keys = [tuple(padded[i : i + depth]) for i in range(len(text))]
    assert [keys[i] for i in index.order] == sorted(keys)
    for sides in ("r" * depth, "l" * depth, "rl" * depth):
        grams = index.single()
        for k in range(1, depth + 1):
            whole = [tuple(text[i : i + k]) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all()]
            assert {tuple(w): int(a) for w, a in zip(grams.words.tolist(), grams.count)} == dict(Counter(whole))
            assert all(tuple(text[b : b + k]) == tuple(grams.words[a]) for a, b in zip(*index.places(grams)))
            if k < depth:
                grams = index.extended(grams, left=sides[k] == "l")


def test_tokens_and_runs():
    texts = ["Ab c,\td\x0be", "", "É a b"]
    lang, piece, index, words = tokens(["x", "y", "x"], texts)
    got = [words[int(i)].as_py().decode() for i in index]
    assert got == ["ab", "c", "d", "e", "É", "a b"] and lang.tolist() == [0] * 6
    assert [len(set(piece.tolist()[a:b])) for a, b in ((0, 2), (2, 3), (0, 4), (3, 6))] == [1, 1, 3, 2]
    links = np.array([True, False, True, True, False, False])
    assert joined(np.arange(1, 7), links, 2).tolist() == [0, 1, 2, 0, 3, 4, 5, 0]
    assert joined(np.arange(0), np.zeros(0, bool), 2).tolist() == [0]
    assert tokens([], [])[2].tolist() == [] and tokens(["x"], [" . "])[2].tolist() == []


def test_phrases_equal_brute_force(spark, folder):
    rows = duckdb.sql(f"SELECT text, lang FROM '{folder}/documents.parquet'").fetchall()
    rows += [("a b c d e f. " * 7, None), ("A B c d", "und"), (None, "en"), ("", None), ("x\ty z z, Ab " * 9, "x\ny"), ("a " * 3000, "x")]
    df = spark.createDataFrame([(1, t, g, "own", 1, 2) for t, g in rows], SCHEMA).repartition(3)
    for longest, least, best in ((5, 4, 50), (2, 3, 2000), (3, 30, 3)):
        got = sorted(tuple(r[n] for n in NAMES) for r in collocations(df, longest, least, best).collect())
        assert got == brute(rows, longest, least, best) and got


def test_little_text(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, "", 1, 1), (2, "one", "en", "", 1, 1)], SCHEMA), least=1).count() == 0
    row = collocations(spark.createDataFrame([(1, "one two", "en", "", 1, 1)], SCHEMA), least=1).collect()[0]
    assert tuple(row[n] for n in NAMES) == ("en", 1, "one two", 1, 1, 1, 2, 2000) and row["left"] is None


def test_score_passes_64_bits(spark):
    from pyspark.sql import functions as F

    from loglattice.llm.phrase_mining import _number

    df = spark.createDataFrame([(10**15, 10**16, 3 * 10**15, 10**15)], "a long, n long, l long, r long")
    got = df.select(F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {_number('a')} * {_number('n')} DIV ({_number('l')} * {_number('r')})")).collect()[0][0]
    assert got == 1000 * 10**31 // (3 * 10**30)


def test_only_counts_per_language_are_broadcast(spark):
    """Words and n-grams grow with the corpus; small here, they are joined as at any size."""
    from loglattice.llm.phrase_mining import candidates

    def joins(df):
        plan = df._jdf.queryExecution()
        df.collect()
        return [set(re.findall(r"\w+Join \[\w+", str(x.toString()))) for x in (plan.sparkPlan(), plan.executedPlan())]

    grams = spark.createDataFrame([([1, 2, 3], 5), ([1, 2], 6), ([2, 3], 7)], "words array<long>, a long")
    assert joins(candidates(grams)) == [{"SortMergeJoin [words"}] * 2
    assert {(tuple(r["words"]), r["left"], r["right"]) for r in candidates(grams).collect()} == {((1, 2, 3), None, None), ((1, 2), None, 5), ((2, 3), 5, None)}
    docs = spark.createDataFrame([(1, "a b c. a b d", "en", "", 1, 1), (2, "e f. e f", "de", "", 1, 1)], SCHEMA)
    for found in joins(collocations(docs, least=1)):
        assert found == {"SortMergeJoin [_first", "SortMergeJoin [_rest", "SortMergeJoin [words", "SortMergeJoin [id", "BroadcastHashJoin [lang"}
