"""Scoring, ranking and fusing many questions against many chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions import scoring
from loglattice.functions import text as tx
from loglattice.operators import bounded, pivots, retrieval
from loglattice.operators.indexing import enrich, postings, save_postings, text_tasks, with_vectors
from loglattice.operators.quality import retrieval_quality
from loglattice.operators.scale import fetch_rows, top_k
from loglattice.plans.knowledge import retrieve
from loglattice.plans.registry import query
from loglattice.plans.views import (
    CHUNKS, DOCS, NOW, NOW_SQL, QUESTIONS, chunks, messages, now_column, questions, raw_documents,
)
from loglattice.plans.preparation import scratch
from loglattice.sources import versions
from loglattice.sources.tables import read_table, spread

BASE = f"WITH {CHUNKS}, {QUESTIONS}"
K = 10

# ------------------------------------------------------------------------- sparse

SPARSE = f"""ctok AS (SELECT chunk_id, created_at, lower(unnest(regexp_extract_all(content, '{tx.TOKEN}'))) AS token FROM chunks),
ctf AS (SELECT chunk_id, token, any_value(created_at) AS created_at, count(*) AS tf FROM ctok GROUP BY chunk_id, token),
cw AS (SELECT *, tf / max(tf) OVER (PARTITION BY chunk_id) AS w, sum(tf) OVER (PARTITION BY chunk_id) AS dl FROM ctf),
qtok AS (SELECT query_id, lower(unnest(regexp_extract_all(question, '{tx.TOKEN}'))) AS token FROM questions),
qtf AS (SELECT query_id, token, count(*) AS tf FROM qtok GROUP BY query_id, token),
qw AS (SELECT *, tf / max(tf) OVER (PARTITION BY query_id) AS w FROM qtf)"""

DF = """dfs AS (SELECT token, count(*) AS df FROM ctf GROUP BY token),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM (SELECT chunk_id, sum(tf) AS dl FROM ctf GROUP BY chunk_id))"""

BM25_TERM = """ln(1 + (n - df + 0.5) / (df + 0.5)) * cw.tf * 2.2 / (cw.tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"""


def _top(scores: str, k: int | str, out: str) -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({scores})) WHERE rank <= {k})"""


TF_DOT = """SELECT query_id, chunk_id, round(sum(qw.w * cw.w), 9) AS score
    FROM cw JOIN qw USING (token) GROUP BY query_id, chunk_id"""
BM25 = f"""SELECT query_id, chunk_id, round(sum({BM25_TERM}), 9) AS score
    FROM cw JOIN qw USING (token) JOIN dfs USING (token), corpus GROUP BY query_id, chunk_id"""

SHOW = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM"


def _shown(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("sparse_tf_dot", f"{BASE}, {SPARSE}, {_top(TF_DOT, K, 'ranked')} {SHOW} ranked")
def sparse_tf_dot(spark, folder):
    return _shown(retrieval.sparse_tf_dot(questions(spark, folder), chunks(spark, folder), K))


@query("sparse_bm25", f"{BASE}, {SPARSE}, {DF}, {_top(BM25, K, 'ranked')} {SHOW} ranked")
def sparse_bm25(spark, folder):
    return _shown(retrieval.sparse_bm25(questions(spark, folder), chunks(spark, folder), K))


def _index(spark, pieces, carry=()):
    """The term index as ingest leaves it: a table bucketed by chunk, in buckets of bounded size."""
    path = scratch(spark, "postings")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    tasks = text_tasks(pieces, "content")
    save_postings(postings(pieces, carry, tasks), table, tasks, path)
    return spark.table(table)


@query("index_tf_dot", f"{BASE}, {SPARSE}, {_top(TF_DOT, K, 'ranked')} {SHOW} ranked")
def index_tf_dot(spark, folder):
    """Ranking over the stored term index."""
    return _shown(retrieval.rank_tf_dot(questions(spark, folder), _index(spark, chunks(spark, folder)), K))


@query("index_bm25", f"{BASE}, {SPARSE}, {DF}, {_top(BM25, K, 'ranked')} {SHOW} ranked")
def index_bm25(spark, folder):
    return _shown(retrieval.rank_bm25(questions(spark, folder), _index(spark, chunks(spark, folder)), K))


@query("bounded_tf_dot", f"{BASE}, {SPARSE}, {_top(TF_DOT, K, 'ranked')} {SHOW} ranked")
def bounded_tf_dot(spark, folder):
    """The same ranking, common tokens met only for candidates whose bound reaches the k-th score."""
    index = _index(spark, chunks(spark, folder))
    return _shown(bounded.bounded_tf_dot(questions(spark, folder), index, K))


@query("bounded_bm25", f"{BASE}, {SPARSE}, {DF}, {_top(BM25, K, 'ranked')} {SHOW} ranked")
def bounded_bm25(spark, folder):
    """BM25 by score bounds, with the index's figures stored by ingest."""
    index, root = _index(spark, chunks(spark, folder)), scratch(spark, "term-stats")
    bounded.save_stats(bounded.term_stats(index), root)
    return _shown(bounded.bounded_bm25(questions(spark, folder), index, K, bounded.load_stats(spark, root)))


# ------------------------------------------------------------------------- dense

_CENTROIDS = """parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
queries AS (SELECT label AS query_id, list(x ORDER BY i) AS qv, TIMESTAMP '2024-01-01' + to_days(label * 30 + 20) AS not_after
            FROM means GROUP BY label)"""


def _centroids(spark, folder):
    """One query vector per label: the mean of its vectors."""
    dims = read_table(spark, folder, "embeddings").select("label", F.posexplode("embedding"))
    means = dims.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    return means.groupBy("label").agg(F.transform(listed, lambda p: p["x"]).alias("vector")).select(
        F.col("label").cast("bigint").alias("query_id"),
        "vector",
        (F.expr("timestamp'2024-01-01'") + F.make_dt_interval(F.col("label") * 30 + 20)).alias("not_after"),
    )


def _vectors(spark, folder):
    days = F.make_dt_interval((F.col("vec_id") % 365).cast("int"))
    return spread(read_table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("embedding").alias("vector"),
        (F.expr("timestamp'2024-01-01'") + days).alias("created_at"),
    )


_COSINE = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9)"


@query(
    "dense_cosine",
    f"""WITH {_CENTROIDS}, {_top(f"SELECT query_id, vec_id AS chunk_id, {_COSINE} AS score FROM queries, embeddings", K, "ranked")}
        {SHOW} ranked""",
)
def dense_cosine(spark, folder):
    return _shown(
        retrieval.dense_cosine(_centroids(spark, folder).drop("not_after"), _vectors(spark, folder), K)
    )


@query(
    "dense_cosine_as_of",
    f"""WITH {_CENTROIDS}, {_top(f'''SELECT query_id, vec_id AS chunk_id, {_COSINE} AS score FROM queries, embeddings
          WHERE TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 365 AS INTEGER)) <= not_after''', K, "ranked")}
        {SHOW} ranked""",
)
def dense_cosine_as_of(spark, folder):
    """Each question sees only vectors created by its own bound."""
    return _shown(retrieval.dense_cosine(_centroids(spark, folder), _vectors(spark, folder), K))


def _by_pivots(spark, questions, vectors):
    root = scratch(spark, "pivots")
    pivots.build(vectors, root)
    return _shown(pivots.nearest(questions, root, K))


@query(
    "pivot_cosine",
    f"""WITH {_CENTROIDS}, {_top(f"SELECT query_id, vec_id AS chunk_id, {_COSINE} AS score FROM queries, embeddings", K, "ranked")}
        {SHOW} ranked""",
)
def pivot_cosine(spark, folder):
    """The dense ranking over a stored pivot index."""
    return _by_pivots(spark, _centroids(spark, folder).drop("not_after"), _vectors(spark, folder))


@query(
    "pivot_cosine_as_of",
    f"""WITH {_CENTROIDS}, {_top(f'''SELECT query_id, vec_id AS chunk_id, {_COSINE} AS score FROM queries, embeddings
          WHERE TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 365 AS INTEGER)) <= not_after''', K, "ranked")}
        {SHOW} ranked""",
)
def pivot_cosine_as_of(spark, folder):
    """The same with every question's own bound."""
    return _by_pivots(spark, _centroids(spark, folder), _vectors(spark, folder))


# Content-hash vectors stand in for embeddings of texts.
DIMS = 32  # exact: the vectors repeat the 32 bytes of one digest
ANCHOR_CHARS = 12  # of a question that documents are first searched for
ANCHORS = 65_536  # that travel to the documents, 8 bytes each


def _hash_sql(text: str) -> str:
    return (
        f"list_transform(range(0, {DIMS}), lambda i: CAST('0x' || substr(sha256({text}), "
        "CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE)"
    )


def _asked(spark, folder):
    """Questions with vectors and an as-of bound."""
    days = F.make_dt_interval((F.col("query_id") % 200 + 165).cast("int"))
    return questions(spark, folder).select(
        "query_id",
        "question",
        tx.hash_vector(F.col("question"), DIMS).alias("vector"),
        (F.expr("timestamp'2024-01-01'") + days).alias("not_after"),
    )


_ASKED = f"""asked AS (SELECT *, {_hash_sql("question")} AS qv,
  TIMESTAMP '2024-01-01' + to_days(CAST(query_id % 200 + 165 AS INTEGER)) AS not_after FROM questions),
cv AS (SELECT *, {_hash_sql("content")} AS v FROM chunks)"""


# ------------------------------------------------------------------------- fusion

_WEIGHT_CLASS = """CASE WHEN regexp_matches(question, '\\b(?:ERR|E)[A-Z0-9_]{2,}\\b')
      OR regexp_matches(question, '(?i)\\b[0-9a-f]{8,}\\b')
      OR regexp_matches(question, '(?:^|[^<])/[^\\s<>]+') THEN 1
    WHEN len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) > 3
      AND NOT regexp_matches(question, '[{}\\[\\]_\\\\]') THEN 2 ELSE 3 END"""
WEIGHTS = f"""weights AS (SELECT query_id, CASE c WHEN 1 THEN 0.3 WHEN 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS w_dense,
    CASE c WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.5 END::DOUBLE AS w_sparse
  FROM (SELECT query_id, {_WEIGHT_CLASS} AS c FROM questions))"""


@query(
    "query_weights",
    f"""WITH questions AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN text
          WHEN 1 THEN 'why ERR_PAYMENT_' || item_id WHEN 2 THEN 'see /var/log/x' || item_id
          WHEN 3 THEN 'payments fail' ELSE 'trace 0ABCDEF' || (item_id % 10) || ' lost' END AS question FROM benchmark),
        {WEIGHTS} SELECT * FROM weights""",
)
def query_weights(spark, folder):
    n = F.col("query_id")
    kinds = F.array(
        F.col("question"),
        F.concat(F.lit("why ERR_PAYMENT_"), n),
        F.concat(F.lit("see /var/log/x"), n),
        F.lit("payments fail"),
        F.concat(F.lit("trace 0ABCDEF"), n % 10, F.lit(" lost")),
    )
    asked = questions(spark, folder).withColumn("question", F.element_at(kinds, (n % 5 + 1).cast("int")))
    return asked.select("query_id", scoring.query_weights(F.col("question")).alias("w")).select(
        "query_id", "w.*"
    )


def _hybrid_sql(limit: str = "4", admitted: str = "TRUE") -> str:
    """Fused candidates; ``limit`` and ``admitted`` may depend on ``query_id`` (and ``source_type``)."""
    return f"""{BASE}, {_ASKED}, {SPARSE}, {DF}, {WEIGHTS},
{_top(f'''SELECT query_id, chunk_id, round(list_cosine_similarity(v, qv), 9) AS score FROM asked, cv
         WHERE created_at <= not_after AND {admitted}''', f"{limit} * 3", "dense")},
{_top(f'''SELECT query_id, chunk_id, round(sum({BM25_TERM}), 9) AS score
    FROM cw JOIN qw USING (token) JOIN dfs USING (token) JOIN (SELECT query_id, not_after FROM asked) USING (query_id)
      JOIN (SELECT chunk_id, source_type FROM chunks) USING (chunk_id), corpus
    WHERE cw.created_at <= not_after AND {admitted} GROUP BY query_id, chunk_id''', f"{limit} * 3", "sparse")},
fused AS (SELECT query_id, chunk_id, round(coalesce(w_dense * (1.0::DOUBLE / (60 + d.rank)), 0)
      + coalesce(w_sparse * (1.0::DOUBLE / (60 + s.rank)), 0), 12) AS score
  FROM (SELECT query_id, chunk_id, rank FROM dense) d FULL JOIN (SELECT query_id, chunk_id, rank FROM sparse) s
    USING (query_id, chunk_id) JOIN weights USING (query_id))"""


_HYBRID = _hybrid_sql()


def _stored_chunks(spark, folder):
    """The chunk table as ingest leaves it: written once, then each retriever reads its columns."""
    root = scratch(spark, "chunks")
    rows = with_vectors(chunks(spark, folder), lambda content: tx.hash_vector(content, DIMS))
    versions.upsert(rows, root, 0)
    return spark.read.parquet(f"{root}/version=0")


@query("fused_ranking", f"{_HYBRID}, {_top('SELECT * FROM fused', 8, 'best')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM best")
def fused_ranking(spark, folder):
    """Weighted reciprocal-rank fusion of a dense and a sparse ranking."""
    asked, stored = _asked(spark, folder), _stored_chunks(spark, folder)
    weights = asked.select("query_id", scoring.query_weights(F.col("question")).alias("w")).select(
        "query_id", "w.*"
    )
    fused = retrieval.fuse(
        retrieval.dense_cosine(asked, stored, 12),
        retrieval.sparse_bm25(asked.drop("vector"), stored, 12),
        weights,
    )
    return _shown(top_k(fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 8))


def _answer_sql(limit: str = "4", admitted: str = "TRUE") -> str:
    return f"""{_hybrid_sql(limit, admitted)}, {_top("SELECT * FROM fused", f"{limit} * 2", "best")},
scored AS (SELECT query_id, chunk_id, round(
    (SELECT count(*) FROM (SELECT token FROM qtf WHERE qtf.query_id = b.query_id) q
       JOIN ctf ON ctf.chunk_id = b.chunk_id AND ctf.token = q.token)
    / (SELECT count(*) FROM qtf WHERE qtf.query_id = b.query_id)
    * CASE WHEN c.tier = 'A' THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN c.accepted THEN 1.15::DOUBLE ELSE 1 END
    * CASE WHEN c.resolution_status = 'deprecated' THEN 0.3::DOUBLE ELSE 1 END
    * exp(-0.02::DOUBLE * greatest(0, epoch({NOW_SQL} - c.created_at) / 86400)), 9) AS score
  FROM best b JOIN chunks c USING (chunk_id)), {_top("SELECT * FROM scored", limit, "answer")}"""


_ANSWER = _answer_sql()


@query("hybrid_retrieval", f"{_ANSWER} SELECT query_id, chunk_id, round(score, 6) AS final_score, rank FROM answer")
def hybrid_retrieval(spark, folder):
    """Dense and sparse retrieval, fusion, reranking, authority and recency for every question."""
    stored = _stored_chunks(spark, folder)
    index = _index(spark, stored, ["created_at"])
    found = retrieve(_asked(spark, folder), stored, 4, index, recency_now=NOW)
    return found.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


# Requests: sources of their own by query_id (none named, one, two, one of them unknown), one to five chunks.
_FILTERS = [[], ["jira"], ["runbook", "github"], ["slack", "nothing"]]
_ADMITTED = """CASE query_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN source_type = 'jira'
    WHEN 2 THEN source_type IN ('runbook', 'github') ELSE source_type IN ('slack', 'nothing') END"""


@query(
    "knowledge_requests",
    f"{_answer_sql('(1 + query_id % 5)', _ADMITTED)} SELECT query_id, chunk_id, round(score, 6) AS final_score, rank FROM answer",
)
def knowledge_requests(spark, folder):
    """The hybrid flow for requests that each name their sources and their number of chunks."""
    stored = _stored_chunks(spark, folder)
    lists = F.array(*[F.array(*[F.lit(s) for s in x]) if x else F.array().cast("array<string>") for x in _FILTERS])
    n = F.col("query_id")
    asked = _asked(spark, folder).select(
        "*", F.element_at(lists, (n % 4 + 1).cast("int")).alias("source_filters"), (1 + n % 5).cast("int").alias("max_chunks")
    )
    found = retrieve(asked, stored, 4, _index(spark, stored, ["created_at", "source_type"]), recency_now=NOW)
    return found.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


@query(
    "top_chunk_pairs",
    f"""{BASE}, {SPARSE}, {_top(TF_DOT, 5, "ranked")}
        SELECT a.query_id, a.chunk_id AS left_id, b.chunk_id AS right_id
        FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank""",
)
def top_chunk_pairs(spark, folder):
    """Candidate pairs for a conflict check among the best five chunks of a question."""
    ranked = retrieval.sparse_tf_dot(questions(spark, folder), chunks(spark, folder), 5)
    return retrieval.top_pairs(ranked, 5)


@query(
    "authority_scores",
    f"""WITH {DOCS} SELECT doc_id, round(10.0 * CASE WHEN tier = 'A' THEN 1.25 ELSE 1 END
          * CASE WHEN accepted THEN 1.15 ELSE 1 END * CASE WHEN resolution_status = 'deprecated' THEN 0.3 ELSE 1 END
          * exp(-0.02::DOUBLE * greatest(0, epoch({NOW_SQL} - created_at) / 86400)), 6) AS final_score FROM tiered""",
)
def authority_scores(spark, folder):
    rows = enrich(raw_documents(spark, folder))
    recency = scoring.recency_factor(F.col("created_at"), now_column())
    score = scoring.authority_score(
        F.lit(10.0), F.lit(None).cast("double"), F.col("authority_tier"), F.col("is_accepted_answer"),
        F.col("resolution_status"), recency,
    )
    return rows.select("doc_id", F.round(score, 6).alias("final_score"))


@query(
    "recency_decay",
    f"""SELECT o_orderkey, round(o_totalprice * exp(-0.02::DOUBLE * greatest(0, epoch(
          TIMESTAMP '1996-06-01' - o_orderdate) / 86400)), 4) AS decayed FROM orders""",
)
def recency_decay(spark, folder):
    """Daily refresh of a score by age; later dates do not grow."""
    now = F.expr("timestamp'1996-06-01 00:00:00'")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(F.col("o_totalprice") * scoring.recency_factor(F.col("o_orderdate"), now), 4).alias("decayed"),
    )


# ------------------------------------------------------------------------- examples by similarity

_EXAMPLES = f"""examples AS (SELECT conv_id * 100 + turn AS example_id, role AS uses_index, {_hash_sql("text")} AS v
                FROM conversations),
qs AS (SELECT item_id AS query_id, {_hash_sql("text")} AS qv FROM benchmark),
sims AS (SELECT query_id, example_id AS chunk_id, uses_index, round(list_cosine_similarity(v, qv), 9) AS score FROM qs, examples)"""
THRESHOLD = 0.88


def _examples(spark, folder):
    return messages(spark, folder).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"),
        F.col("role").alias("uses_index"),
        tx.hash_vector(F.col("text"), DIMS).alias("vector"),
    )


@query("similar_examples", f"WITH {_EXAMPLES}, {_top('SELECT * FROM sims', 4, 'ranked')} {SHOW} ranked")
def similar_examples(spark, folder):
    """Four nearest stored examples per question."""
    return _shown(retrieval.dense_cosine(_asked(spark, folder).drop("not_after"), _examples(spark, folder), 4))


@query(
    "examples_with_fallback",
    f"""WITH {_EXAMPLES}, {_top('SELECT * FROM sims', 4, 'ranked')},
        kept AS (SELECT * FROM ranked WHERE score >= {THRESHOLD}),
        n AS (SELECT query_id, count(k.chunk_id) AS n FROM qs LEFT JOIN kept k USING (query_id) GROUP BY query_id),
        static AS (SELECT conv_id * 100 + turn AS example_id, row_number() OVER (ORDER BY conv_id * 100 + turn) AS rank
                   FROM conversations QUALIFY rank <= 4)
        SELECT query_id, chunk_id AS example_id, rank, 'similar' AS origin FROM kept JOIN n USING (query_id) WHERE n >= 2
        UNION ALL SELECT query_id, example_id, rank, 'fallback' FROM n, static WHERE n < 2""",
)
def examples_with_fallback(spark, folder):
    """Similar examples above the threshold, or the static ones when fewer than two are."""
    asked, examples = _asked(spark, folder).drop("not_after"), _examples(spark, folder)
    kept = retrieval.dense_cosine(asked, examples, 4).where(F.col("score") >= THRESHOLD)
    static = examples.select(F.col("chunk_id").alias("position"), F.col("chunk_id").alias("example_id"))
    return retrieval.with_fallback(asked, kept.withColumnRenamed("chunk_id", "example_id"), static)


@query(
    "examples_for_indices",
    f"""WITH {_EXAMPLES}, {_top('SELECT * FROM sims', 8, 'near')},
        allowed AS (SELECT query_id, unnest(CASE WHEN query_id % 2 = 0 THEN ['user', 'system'] ELSE ['assistant'] END) AS uses_index FROM qs),
        ok AS (SELECT near.* FROM near JOIN allowed USING (query_id, uses_index))
        SELECT query_id, chunk_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM ok)
        WHERE pos <= 4""",
)
def examples_for_indices(spark, folder):
    """Eight nearest, those naming an index outside the selection dropped, four kept."""
    asked, examples = _asked(spark, folder).drop("not_after"), _examples(spark, folder)
    near = retrieval.dense_cosine(asked, examples, 8)
    uses = fetch_rows(examples.select("chunk_id", "uses_index"), near, "chunk_id", asked, 8)
    choice = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("user"), F.lit("system"))).otherwise(
        F.array(F.lit("assistant"))
    )
    allowed = asked.select("query_id", F.explode(choice).alias("uses_index"))
    ok = uses.join(allowed, ["query_id", "uses_index"], "left_semi")
    return top_k(ok, ["query_id"], [F.asc("rank")], 4, "pos").select("query_id", "chunk_id", "pos")


# ------------------------------------------------------------------------- quality


def _wanted(anchored):
    """By size, the sorted anchors, or where they are too many to travel, the largest."""
    few = anchored.select("size", "hash").distinct().limit(ANCHORS + 1).toArrow()
    sizes, hashes = (few.column(c).to_numpy() for c in ("size", "hash"))
    if few.num_rows <= ANCHORS:
        return {n: np.sort(hashes[sizes == n]) for n in sorted(set(sizes.tolist()))}
    bounds = anchored.groupBy("size").agg(F.max("hash").alias("most")).collect()  # ANCHOR_CHARS rows at most
    return {row["size"]: row["most"] for row in sorted(bounds)}


def _truth(spark, folder):
    """(query_id, doc_id) pairs where the document holds the whole question; an empty one has none.

    A question is anchored on one run of its characters, that with the smallest hash, so any
    text has an anchor.  Documents give away only runs whose hash is an anchor (of more than
    ``ANCHORS``: no larger than the largest), meet the questions on them by an equality join, and
    the texts of those that met are then compared in full.
    """
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    asked = questions(spark, folder).select("query_id", "question").where("question <> ''")
    size = F.least(F.char_length("question"), F.lit(ANCHOR_CHARS))
    anchored = asked.select("query_id", size.alias("size"), F.array_min(tx.run_hashes(F.col("question"), size)).alias("hash"))
    wanted = _wanted(anchored)
    if not wanted:
        return asked.select("query_id", F.lit(None).cast("long").alias("doc_id")).limit(0)
    keys = tx.runs_among(docs, "doc_id", "text", wanted).join(anchored, ["size", "hash"]).select("doc_id", "query_id").distinct()
    met = docs.join(keys, "doc_id").join(asked, "query_id")
    return met.where(F.contains(F.col("text"), F.col("question"))).select("query_id", "doc_id").distinct()


_TRUTH = """truth AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b, documents d
                      WHERE b.text <> '' AND contains(d.text, b.text))"""


def _quality_sql(scores: str, extra: str, k: int) -> str:
    return f"""{BASE}, {SPARSE}{extra}, {_TRUTH}, {_top(scores, k, "ranked")},
      per AS (SELECT t.query_id, count(DISTINCT t.doc_id) AS n_true, count(DISTINCT CASE WHEN c.doc_id = t.doc_id THEN t.doc_id END) AS hits,
                min(CASE WHEN c.doc_id = t.doc_id THEN rank END) AS best
              FROM truth t LEFT JOIN ranked r ON r.query_id = t.query_id LEFT JOIN chunks c ON c.chunk_id = r.chunk_id
              GROUP BY t.query_id)
      SELECT count(*) AS n_queries, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(hits) AS BIGINT) AS n_found,
        round(avg(hits / n_true), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM per"""


def _quality(spark, folder, retriever, k):
    pieces = chunks(spark, folder)
    ranked = retriever(questions(spark, folder), pieces, k).select(
        "query_id", F.regexp_extract("chunk_id", r"^(\d+)-", 1).cast("bigint").alias("doc_id"), "rank"
    )
    report = retrieval_quality(ranked, _truth(spark, folder), k)
    return report.select(
        "n_queries", "n_true", "n_found", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr")
    )


@query("quality_tf_dot", _quality_sql(TF_DOT, "", 10))
def quality_tf_dot(spark, folder):
    return _quality(spark, folder, retrieval.sparse_tf_dot, 10)


@query("quality_bm25", _quality_sql(BM25, ", " + DF, 3))
def quality_bm25(spark, folder):
    return _quality(spark, folder, retrieval.sparse_bm25, 3)


# ------------------------------------------------------------------------- routing and selection

_ROUTED = """routed AS (SELECT item_id, lower(CASE item_id % 6 WHEN 0 THEN 'How to ' || text WHEN 1 THEN 'Count ' || text
    WHEN 2 THEN 'why did the count ' || text WHEN 3 THEN 'HOW MANY ' || text || ' failed'
    WHEN 4 THEN 'the average of ' || text ELSE text END) AS q FROM benchmark),
flags AS (SELECT item_id, regexp_matches(q, '\\bbest practice\\b|\\bhow to\\b|\\barchitecture\\b') AS docs_only,
    regexp_matches(q, '\\bcount\\b|\\bhow many\\b|\\bsum\\b|\\baverage\\b') AS quant,
    regexp_matches(q, '\\bwhy\\b|\\bfailed\\b|\\berror\\b|\\bcause\\b') AS trouble FROM routed)"""


@query(
    "route_questions",
    f"""WITH {_ROUTED} SELECT item_id, NOT docs_only AS logs_needed, docs_only OR NOT (quant AND NOT trouble) AS docs_needed,
          NOT docs_only AND quant AND NOT trouble AS is_quantitative,
          docs_only OR NOT (quant AND NOT trouble) AS is_qualitative FROM flags""",
)
def route_questions(spark, folder):
    q = F.col("text")
    kinds = F.array(
        F.concat(F.lit("How to "), q), F.concat(F.lit("Count "), q), F.concat(F.lit("why did the count "), q),
        F.concat(F.lit("HOW MANY "), q, F.lit(" failed")), F.concat(F.lit("the average of "), q), q,
    )
    asked = read_table(spark, folder, "benchmark").withColumn(
        "q", F.element_at(kinds, (F.col("item_id") % 6 + 1).cast("int"))
    )
    return asked.select("item_id", meta.route(F.col("q")).alias("r")).select("item_id", "r.*")


@query(
    "sentence_selection",
    f"""WITH pairs AS (SELECT a.conv_id, a.turn, list_distinct(list_transform(regexp_extract_all(u.text, '{tx.TOKEN}'), lambda x: lower(x))) AS q,
            a.text, 40 + a.conv_id % 60 AS budget
          FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
        runs AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'),
            lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ss FROM pairs),
        sents AS (SELECT conv_id, turn, q, budget, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM runs),
        hits AS (SELECT *, length(s) // 4 AS n, len(list_intersect(q, list_distinct(list_transform(
            regexp_extract_all(s, '{tx.TOKEN}'), lambda x: lower(x))))) AS h FROM sents),
        cut AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn ORDER BY h DESC, i) AS used FROM hits)
        SELECT p.conv_id, p.turn, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (WHERE used <= c.budget), '') AS compacted
        FROM pairs p LEFT JOIN cut c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY p.conv_id, p.turn""",
)
def sentence_selection(spark, folder):
    """Replies compacted to the sentences closest to the message they answer."""
    said = messages(spark, folder)
    asked = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = said.join(asked, ["conv_id", "turn"]).withColumn(
        "q", F.array_distinct(tx.tokens(F.col("question")))
    )
    budget = F.lit(40) + F.col("conv_id") % 60
    return retrieval.select_sentences(pairs, F.col("q"), budget).select("conv_id", "turn", "compacted")
