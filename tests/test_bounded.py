"""Ranking by score bounds equals ranking everything, and meets no common token."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.operators import bounded, retrieval
from loglattice.operators.indexing import postings, save_postings

T0 = datetime(2026, 1, 1)
COLUMNS = ("query_id", "chunk_id", "score", "rank")
PAIRS = [(bounded.bounded_tf_dot, retrieval.sparse_tf_dot), (bounded.bounded_bm25, retrieval.sparse_bm25)]


@pytest.fixture(scope="module")
def zipf(spark):
    """Chunks of words with falling frequency; every chunk has "the"; a third are one text."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(600):
        words = ["the"] * rng.randint(1, 4) + (["same", "w1"] if i % 3 == 0 else rng.choices(vocabulary, weights, k=rng.randint(3, 40)))
        rows.append((f"c{i:03d}", " ".join(words), T0 + timedelta(days=i % 50), f"s{i % 3}"))
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, created_at timestamp, source_type string")
    asked = [(q, "the " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))) for q in range(40)] + [(90, "the"), (91, "the same"), (92, "absent"), (93, None)]
    return spark.createDataFrame(asked, "query_id int, question string"), chunks


@pytest.mark.parametrize(("by_bounds", "whole"), PAIRS)
@pytest.mark.parametrize("k", [1, 1000])
def test_same_rows(zipf, by_bounds, whole, k):
    questions, chunks = zipf
    assert values(by_bounds(questions, postings(chunks), k), *COLUMNS) == values(whole(questions, chunks, k), *COLUMNS)


@pytest.mark.parametrize(("by_bounds", "whole"), PAIRS)
def test_shuffled_plan_gives_the_same(zipf, by_bounds, whole, monkeypatch):
    questions, chunks = zipf
    expected = values(whole(questions, chunks, 5), *COLUMNS)
    monkeypatch.setattr(bounded, "fits_broadcast", lambda *a, **k: False)
    assert values(by_bounds(questions, postings(chunks), 5), *COLUMNS) == expected


@pytest.mark.parametrize(("by_bounds", "whole"), PAIRS)
def test_limits_of_each_question(zipf, by_bounds, whole):
    questions, chunks = zipf
    index = postings(chunks, ["created_at", "source_type"])
    dated = questions.withColumn("not_after", F.when(F.col("query_id") % 3 > 0, F.lit(T0) + F.make_dt_interval(F.col("query_id") % 50)))
    assert values(by_bounds(dated, index, 6), *COLUMNS) == values(whole(dated, chunks, 6), *COLUMNS)
    allowed = F.when(F.col("query_id") % 4 == 0, F.array(F.lit("s1"))).when(F.col("query_id") % 4 == 1, F.array(F.lit("s0"), F.lit("s2")))
    got = by_bounds(questions.withColumn("sources", allowed), index, 1000)
    source = {r["chunk_id"]: r["source_type"] for r in chunks.collect()}
    sets = {0: {"s1"}, 1: {"s0", "s2"}}
    every = [r for r in values(whole(questions, chunks, 1000), "query_id", "chunk_id", "score")]
    expected = [r for r in every if source[r[1]] in sets.get(r[0] % 4, {"s0", "s1", "s2"})]
    assert values(got, "query_id", "chunk_id", "score") == expected


def test_many_candidates_leave_the_index_in_place(spark, zipf, monkeypatch, tmp_path):
    """Too many lookups to travel: the postings are met where they lie, not moved by (chunk, token)."""
    questions, chunks = zipf
    save_postings(postings(chunks), "many_candidates", 4, str(tmp_path / "many_candidates"))
    fits = bounded.fits_broadcast
    monkeypatch.setattr(bounded, "fits_broadcast", lambda df, *a: "chunk_id" not in df.columns and fits(df, *a))
    got = bounded.bounded_bm25(questions, spark.table("many_candidates"), 5)
    assert values(got, *COLUMNS) == values(retrieval.sparse_bm25(questions, chunks, 5), *COLUMNS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(chunk_id") == 0


def test_no_rows_for_common_tokens(spark, zipf):
    """Questions with rare words: "the", in all 600 chunks, is not essential and names no candidate."""
    _, chunks = zipf
    index = postings(chunks).cache()
    stats = bounded.term_stats(index)
    questions = spark.createDataFrame([(1, "the w50 w60 w70"), (2, "the the w33 w44")], "query_id int, question string")
    corpus = stats.corpus.first()
    part = bounded.bm25_part(F.lit(corpus["avgdl"]))
    terms = bounded._terms(questions).drop("qw").join(stats.tokens, "token")
    terms = terms.withColumn("factor", bounded.scoring.bm25_idf(F.col("df"), F.lit(corpus["n"]))).withColumnRenamed("top_bm25", "top")
    split = bounded.split_terms(index, terms, part, 3, [])
    common = split.where("token = 'the'").collect()
    assert len(common) == 2 and not any(r["essential"] for r in common) and all(r["df"] == 600 for r in common)
    essential = split.where("essential").select("token", "df").collect()
    found = bounded.candidates(index, split, part, [], F.broadcast)
    assert found.count() <= sum(r["df"] for r in essential) < 200
