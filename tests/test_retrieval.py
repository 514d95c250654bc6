import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.functions import scoring
from loglattice.operators import indexing, retrieval
from loglattice.operators.indexing import postings, save_postings, with_vectors
from loglattice.operators import scale
from loglattice.plans import ranking
from loglattice.plans.knowledge import retrieve

T0 = datetime(2026, 1, 1)


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    ("question", "weights"),
    [
        ("how do I configure the payments service?", (0.7, 0.3)),
        ("why am I getting ERR_PAYMENT_FAILED?", (0.3, 0.7)),
        ("payments fail", (0.5, 0.5)),
        ("trace deadbeef42 is missing today", (0.3, 0.7)),
        ("look into /var/log please now", (0.3, 0.7)),
        ("what does a[0] mean here", (0.5, 0.5)),
    ],
)
def test_query_weights(spark, question, weights):
    assert tuple(one(spark, scoring.query_weights(F.col("t")), question)) == weights


def test_query_weights_ignoring_case(spark):
    question = "how does everything work together"
    assert one(spark, scoring.query_weights(F.col("t")), question)[0] == 0.7
    assert one(spark, scoring.query_weights(F.col("t"), error_code_ignores_case=True), question)[0] == 0.3


def test_fusion(spark):
    schema = "query_id int, chunk_id string, rank int"
    dense = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], schema)
    sparse = spark.createDataFrame([(1, "c2", 1), (1, "c3", 2)], schema)
    weights = spark.createDataFrame([(1, 0.5, 0.5)], "query_id int, w_dense double, w_sparse double")
    got = retrieval.fuse(dense, sparse, weights).orderBy(F.desc("score")).collect()
    assert [r["chunk_id"] for r in got] == ["c2", "c1", "c3"]
    assert [r["score"] for r in got] == pytest.approx([0.5 / 62 + 0.5 / 61, 0.5 / 61, 0.5 / 62], abs=1e-11)


@pytest.mark.parametrize(
    ("tier", "accepted", "status", "score"),
    [("A", False, "unknown", 12.5), ("B", True, "unknown", 11.5), ("B", False, "open", 10.0), ("A", False, "deprecated", 3.75)],
)
def test_authority(spark, tier, accepted, status, score):
    column = scoring.authority_score(
        F.lit(0.5), F.lit(10.0), F.lit(tier), F.lit(accepted), F.lit(status), F.lit(1.0)
    )
    assert one(spark, column) == pytest.approx(score)


def test_authority_falls_back_to_fused(spark):
    none = F.lit(None).cast("double")
    column = scoring.authority_score(F.lit(2.0), none, F.lit("B"), F.lit(False), F.lit("open"), F.lit(0.5))
    assert one(spark, column) == 1.0


def test_recency(spark):
    factor = lambda days: one(spark, scoring.recency_factor(F.lit(T0 - timedelta(days=days)), F.lit(T0)))
    assert factor(0) >= 0.99 and 0.36 < factor(50) < 0.38 and factor(-5) == 1.0


@pytest.mark.parametrize(
    ("payload", "expected"),
    [('{"confidence": 1.7}', 1.0), ('{"confidence": -2}', 0.0), ('{"confidence": 0.25}', 0.25),
     ('{"confidence": "0.9"}', 0.5), ('{"confidence": "high"}', 0.5), ("{}", None)],
)
def test_clamp(spark, payload, expected):
    assert one(spark, scoring.clamp_confidence(F.col("t")), payload) == expected


def test_confidence(spark):
    score = lambda *a: one(spark, scoring.confidence(*[F.lit(x) for x in a]))
    assert score(5, 10, 2, 4, True) == pytest.approx(0.3 + 0.15 + 0.1)
    assert score(0, 0, 0, 0, False) == 0.0


# ---------------------------------------------------------------- dense


def brute(queries, vectors, k, bounds=None, times=None):
    out = set()
    for q, qv in queries.items():
        scored = []
        for c, cv in vectors.items():
            if bounds and times[c] > bounds[q]:
                continue
            s = round(float(np.dot(qv, cv) / (np.linalg.norm(qv) * np.linalg.norm(cv))), 9)
            scored.append((-s, c))
        out |= {(q, c, i + 1) for i, (_, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    vectors = {f"c{i:03d}": rng.normal(size=6) for i in range(150)}
    for i in range(60):  # a third are copies of one vector: ties must go to the smaller id
        vectors[f"c{i * 2:03d}"] = np.arange(6.0) + 1
    queries = {i: rng.normal(size=6) for i in range(9)}
    queries[9] = np.arange(6.0) + 1
    times = {c: T0 + timedelta(days=i % 40) for i, c in enumerate(vectors)}
    bounds = {q: T0 + timedelta(days=q * 4) for q in queries}
    return queries, vectors, times, bounds


@pytest.mark.parametrize("block", [100, 3, 1])
def test_dense_blocks_match_brute_force(spark, cloud, block):
    queries, vectors, times, bounds = cloud
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries.items()], "query_id int, vector array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "chunk_id string, vector array<double>")
    got = retrieval.dense_cosine(q, c.repartition(5), 7, block)
    assert set(values(got, "query_id", "chunk_id", "rank")) == brute(queries, vectors, 7)


def test_dense_as_of(spark, cloud):
    queries, vectors, times, bounds = cloud
    q = spark.createDataFrame(
        [(i, v.tolist(), bounds[i]) for i, v in queries.items()], "query_id int, vector array<double>, not_after timestamp"
    )
    c = spark.createDataFrame(
        [(i, v.tolist(), times[i]) for i, v in vectors.items()], "chunk_id string, vector array<double>, created_at timestamp"
    )
    got = retrieval.dense_cosine(q, c, 5)
    assert set(values(got, "query_id", "chunk_id", "rank")) == brute(queries, vectors, 5, bounds, times)


def test_dense_without_questions_or_vectors(spark):
    q = spark.createDataFrame([], "query_id int, vector array<double>")
    c = spark.createDataFrame([("a", None), ("b", [1.0])], "chunk_id string, vector array<double>")
    assert retrieval.dense_cosine(q, c, 3).count() == 0
    asked = spark.createDataFrame([(1, [2.0])], "query_id int, vector array<double>")
    assert values(retrieval.dense_cosine(asked, c, 3), "chunk_id", "score") == [("b", 1.0)]


# ---------------------------------------------------------------- sparse


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = [(f"c{i}", f"the {'the ' * (i % 3)} word{i % 7} error{i % 5} x", T0 + timedelta(days=i)) for i in range(60)]
    asked = [(1, "the error1"), (2, "word3 word3 x"), (3, "absent")]
    return (
        spark.createDataFrame(asked, "query_id int, question string"),
        spark.createDataFrame(chunks, "chunk_id string, content string, created_at timestamp"),
    )


@pytest.mark.parametrize("scorer", [retrieval.sparse_tf_dot, retrieval.sparse_bm25])
def test_salted_join_gives_the_broadcast_answer(corpus, scorer, monkeypatch):
    expected = values(scorer(*corpus, 8), "query_id", "chunk_id", "score", "rank")
    assert {r[0] for r in expected} == {1, 2}
    monkeypatch.setattr(retrieval, "fits_broadcast", lambda *a, **k: False)
    assert values(scorer(*corpus, 8), "query_id", "chunk_id", "score", "rank") == expected


def test_tf_dot_arithmetic(spark):
    q = spark.createDataFrame([(1, "a a b")], "query_id int, question string")
    c = spark.createDataFrame([("x", "a b b"), ("y", "c")], "chunk_id string, content string")
    got = retrieval.sparse_tf_dot(q, c, 5).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("x", 1.0 * 0.5 + 0.5 * 1.0)]


def test_sparse_as_of(corpus):
    questions, chunks = corpus
    bounded = questions.withColumn("not_after", F.lit(T0 + timedelta(days=9)))
    for scorer in (retrieval.sparse_tf_dot, retrieval.sparse_bm25):
        got = {r[0] for r in values(scorer(bounded, chunks, 100), "chunk_id")}
        assert got and got <= {f"c{i}" for i in range(10)}


def test_top_pairs(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (2, "a", 1)], "query_id int, chunk_id string, rank int")
    got = values(retrieval.top_pairs(ranked, 3), "query_id", "left_id", "right_id")
    assert got == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


def test_fallback(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    kept = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, example_id bigint, rank int")
    static = spark.createDataFrame([(i, 90 + i) for i in range(6)], "position int, example_id bigint")
    got = values(retrieval.with_fallback(q, kept, static), "query_id", "example_id", "origin")
    assert [g for g in got if g[0] == 1] == [(1, 10, "similar"), (1, 11, "similar")]
    for query_id in (2, 3):
        assert [g[1] for g in got if g[0] == query_id] == [90, 91, 92, 93]


def test_requests_with_sources_and_limits_of_their_own(spark):
    chunks = spark.createDataFrame(
        [(f"c{i:02d}", f"word{i % 6} common text {i}", [float(i % 5), 1.0, float(i % 3)], T0, "B", False, "open", 1.0, f"s{i % 3}") for i in range(30)],
        "chunk_id string, content string, vector array<double>, created_at timestamp, authority_tier string, "
        "is_accepted_answer boolean, resolution_status string, recency_score double, source_type string",
    )
    shape = "query_id int, question string, vector array<double>, source_filters array<string>, max_chunks int"
    cases = [(1, ["s1"], 2), (2, [], 3), (3, None, None), (4, ["s0", "s2", "nothing"], 5), (5, ["nothing"], 4), (6, ["s1", None], 0), (7, ["s2"], 1)]
    rows = [(q, "word1 common", [1.0, 1.0, 0.0], filters, limit) for q, filters, limit in cases]
    show = ("query_id", "chunk_id", "rank", "final_score")
    together = values(retrieve(spark.createDataFrame(rows, shape), chunks, 4, postings(chunks, ["source_type"])), *show)
    for q, filters, limit in cases:
        own = [r for r in together if r[0] == q]
        assert len(own) == (0 if filters == ["nothing"] else 4 if limit is None else limit)
        assert not filters or {f"s{int(r[1][1:]) % 3}" for r in own} <= set(filters)
    plain = spark.createDataFrame([(2, "word1 common", [1.0, 1.0, 0.0])], "query_id int, question string, vector array<double>")
    assert [r for r in together if r[0] == 2] == values(retrieve(plain, chunks, 3), *show)


def test_hybrid_limits_and_fetch_paths(spark, monkeypatch):
    n = 40
    chunks = spark.createDataFrame(
        [(f"c{i:02d}", f"word{i % 6} common text {i}", [float(i % 5), 1.0, float(i % 3)], T0, "A" if i % 2 else "B", False, "open", 1.0) for i in range(n)],
        "chunk_id string, content string, vector array<double>, created_at timestamp, authority_tier string, "
        "is_accepted_answer boolean, resolution_status string, recency_score double",
    )
    asked = spark.createDataFrame([(1, "word1 common", [1.0, 1.0, 0.0]), (2, "word2", [0.0, 1.0, 2.0])], "query_id int, question string, vector array<double>")
    expected = values(retrieve(asked, chunks, 2), "query_id", "chunk_id", "rank", "final_score")
    assert len(expected) == 4
    index = postings(chunks)
    assert values(retrieve(asked, chunks, 2, index), "query_id", "chunk_id", "rank", "final_score") == expected
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert values(retrieve(asked, chunks, 2), "query_id", "chunk_id", "rank", "final_score") == expected


def test_sentence_selection(spark):
    df = spark.createDataFrame([("First about cats. Then dogs run fast! Cats sleep.",)], "text string")
    chosen = lambda budget: retrieval.select_sentences(df, F.array(F.lit("cats")), F.lit(budget)).first()["compacted"]
    assert chosen(100) == "First about cats. Then dogs run fast! Cats sleep."
    assert chosen(7) == "First about cats. Cats sleep."
    assert chosen(1) == ""


def test_stored_index_shuffles_no_terms(spark, corpus, tmp_path):
    questions, chunks = corpus
    save_postings(postings(chunks), "stored_terms", 4, str(tmp_path / "stored_terms"))
    index = spark.table("stored_terms")
    for ranked, direct in (
        (retrieval.rank_tf_dot, retrieval.sparse_tf_dot), (retrieval.rank_bm25, retrieval.sparse_bm25),
    ):
        got = ranked(questions, index, 8)
        columns = ("query_id", "chunk_id", "score", "rank")
        assert values(got, *columns) == values(direct(*corpus, 8), *columns)
    plan = retrieval.rank_tf_dot(questions, index, 8)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]
    assert above.count("Exchange") == 1  # only the last top-k moves rows


def test_a_task_counts_the_terms_of_a_bounded_text(spark, monkeypatch):
    """Four times the text takes four times the tasks."""
    monkeypatch.setattr(indexing, "TASK_TEXT", 1000)
    most = []
    for n in (400, 1600):
        chunks = spark.range(n).select(F.format_string("c%04d", "id").alias("chunk_id"), F.lit("some words of one chunk").alias("content"))
        weights = indexing.term_weights(chunks, "chunk_id", "content")
        most.append(max(r["n"] for r in weights.groupBy(F.spark_partition_id()).agg(F.countDistinct("chunk_id").alias("n")).collect()))
    assert most[1] < 2 * most[0] < 200


@pytest.mark.parametrize("scorer", [retrieval.sparse_tf_dot, retrieval.sparse_bm25])
def test_a_task_sums_the_scores_of_a_bounded_text(spark, monkeypatch, scorer):
    """Sums per (question, chunk) stay where the text is, in as many tasks as the text needs."""
    monkeypatch.setattr(indexing, "TASK_TEXT", 1000)
    text = "some words of one chunk"
    questions = spark.createDataFrame([(1, "some words"), (2, "one chunk")], "query_id int, question string")
    for n in (400, 1600):
        chunks = spark.range(n).select(F.format_string("c%04d", "id").alias("chunk_id"), F.lit(text).alias("content"))
        ranked = scorer(questions, chunks, 3)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk_id#" in plan and f", {-(-n * len(text) // 1000)}), REPARTITION_BY_NUM" in plan
        assert "hashpartitioning(query_id#" in plan and not re.search(r"hashpartitioning\(query_id#\w+, chunk_id", plan)
        assert ranked.count() == 6


def test_the_stored_index_has_as_many_buckets_as_its_text_needs(spark, monkeypatch):
    monkeypatch.setattr(indexing, "TASK_TEXT", 50)
    chunks = spark.createDataFrame([(f"c{i}", f"some words of chunk {i}") for i in range(40)], "chunk_id string, content string")
    index = ranking._index(spark, chunks)
    files = {f.split("_")[-1] for f in index.inputFiles()}
    assert index.select("chunk_id").distinct().count() == 40 and len(files) > 8


def test_supplied_embedder_and_scorer(spark):
    @F.pandas_udf("array<float>")
    def embed(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [float(len(c)), 1.0])

    @F.pandas_udf("double")
    def score(question: pd.Series, content: pd.Series) -> pd.Series:
        return (question.str.len() - content.str.len()).astype(float)

    chunks = spark.createDataFrame([("c1", "abc"), ("c2", "abcdef")], "chunk_id string, content string")
    vectors = with_vectors(chunks, embed)
    assert values(vectors, "chunk_id", "vector") == [("c1", [3.0, 1.0]), ("c2", [6.0, 1.0])]
    pairs = chunks.withColumn("question", F.lit("abcde"))
    got = values(retrieval.rerank(pairs, score), "chunk_id", "cross_encoder_score")
    assert got == [("c1", 2.0), ("c2", -1.0)]
    assert values(retrieval.rerank(pairs.withColumn("question", F.lit("abc x"))), "cross_encoder_score") == [(0.0,), (0.5,)]


def test_truth_of_any_writing(spark, tmp_path):
    from loglattice.plans.ranking import _truth

    texts = {1: "before 東京都は日本の首都である。 after", 2: "a few short words here", 3: "nothing of the kind", 4: "東京都は日本の首都では", 5: None}
    asked = {1: "東京都は日本の首都である。", 2: "few short words", 3: "w", 4: "", 5: "few short words here and more"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = {(q, d) for q, v in asked.items() for d, t in texts.items() if v and t and v in t}
    assert {tuple(r) for r in _truth(spark, str(tmp_path)).collect()} == held


@pytest.mark.parametrize(("span", "found", "anchors"), [(7, 3, 1000), (5, 2, 2), (1 << 18, 1 << 16, 0)])
def test_documents_never_send_all_their_runs(spark, tmp_path, monkeypatch, span, found, anchors):
    """Texts are hashed in spans in the tasks; runs that no question is anchored on stay there."""
    from loglattice.functions import text as tx

    monkeypatch.setattr(tx, "SPAN", span)
    monkeypatch.setattr(tx, "FOUND", found)
    monkeypatch.setattr(ranking, "ANCHORS", anchors)
    long = " ".join(f"w{i}" for i in range(400)) + " 東京 😀 end"
    texts = [(1, long), (2, long[:900]), (2, "ab"), (3, None), (None, long), (4, "xa" * 30), (5, "")]
    asked = [(1, long[100:160]), (2, "東京 😀 end"), (3, "w7"), (4, "x"), (4, "ab"), (5, ""), (6, None), (7, long[100:160]), (None, "xaxa")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    truth = ranking._truth(spark, str(tmp_path))
    held = {(q, d) for q, v in asked for d, t in texts if q and d and v and t and v in t}
    assert sorted(map(tuple, truth.collect())) == sorted(held)
    plan = truth._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "hashed(question" in plan and "hashed(text" not in plan
    sent = tx.runs_among(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", {4: np.array([2**62])})
    assert sent.count() == 0


def test_dense_questions_of_unlike_vectors(spark):
    from loglattice.operators.retrieval import dense_cosine

    asked = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, None), (6, [])]
    asked += [(7, [0.0, 1.0])] * 9
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0, 2.0])], "chunk_id string, vector array<double>")
    found = {(r["query_id"], r["chunk_id"], r["score"]) for r in dense_cosine(queries, chunks, 1, block=2).collect()}
    assert found == {(1, "a", 1.0), (2, "c", 0.0), (7, "b", 1.0)}
