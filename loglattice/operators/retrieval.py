"""Sparse, dense and fused ranking of many questions against many chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import scoring
from loglattice.functions import text as tx
from loglattice.functions.predicates import as_of
from loglattice.operators.indexing import place, placed_counts, term_weights, tokenised
from loglattice.operators.scale import fits_broadcast, salted_join, top_k
from loglattice.session import shared_dir

CANDIDATES, RERANKED = 3, 2  # fixed values: over-fetch factors per retriever and reranker
SALTS = 64
BOUNDS = {"not_after": "created_at", "source_filters": "source_type"}  # of a question: the chunk's column it is held against
QUERY_BLOCK = 4096  # question vectors one task holds at a time


def question_terms(questions: DataFrame, query_id: str = "query_id", text: str = "question") -> DataFrame:
    """``(query_id, token, qw[, not_after, source_filters])`` with qw = tf / max tf of the question."""
    carry = [c for c in BOUNDS if c in questions.columns]
    weights = term_weights(questions.select(query_id, text, *carry), query_id, text, carry)
    return weights.select(query_id, "token", F.col("weight").alias("qw"), *carry)


def any_source(filters: str) -> Column:
    """Whether a question admits every source: no list, or an empty one."""
    return F.coalesce(F.size(filters), F.lit(0)) <= 0


def _carried(questions: DataFrame) -> list[str]:
    return [column for bound, column in BOUNDS.items() if bound in questions.columns]


def _ranked(postings: DataFrame, asked: DataFrame, small: bool, weight: Column, k: int) -> DataFrame:
    """Meet on token, sum per (question, chunk), keep the best k per question.

    Question terms measured small travel to the postings, which stay where their chunk
    is, so sums and the first cut need no shuffle; otherwise the join shuffles with the
    frequent tokens salted.  Question bounds drop later chunks before the sums.
    """
    if small:
        met = postings.join(F.broadcast(asked), "token")
    else:
        met = salted_join(postings, asked, "token", SALTS, ["chunk_id"])
    if "not_after" in asked.columns:
        unbounded = F.col("not_after").isNull()
        met = met.where(unbounded | as_of(F.col("created_at"), F.col("not_after")))
    if "source_filters" in asked.columns:
        met = met.where(any_source("source_filters") | F.array_contains("source_filters", F.col("source_type")))
    scores = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 9).alias("score"))
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def sparse_tf_dot(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top-k chunks per question by the dot product of tf / max-tf weights.

    ``questions(query_id, question[, not_after, source_filters])``,
    ``chunks(chunk_id, content[, created_at, source_type])``.
    """
    asked = question_terms(questions)
    carry = _carried(questions)
    postings = term_weights(chunks, "chunk_id", "content", carry).drop("idx")
    return _ranked(postings, asked, fits_broadcast(asked), F.col("qw") * F.col("weight"), k)


def sparse_bm25(
    questions: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """Top-k chunks per question by Okapi BM25 over the distinct question tokens."""
    asked = question_terms(questions).drop("qw")
    carry = _carried(questions)
    small = fits_broadcast(asked)
    hint = F.broadcast if small else (lambda df: df)
    wanted = asked.select("token").distinct()
    placed = place(chunks, "chunk_id", "content", carry)
    counts = placed_counts(placed, "chunk_id", "content", carry, hint(wanted) if small else None)
    lengths = tokenised(placed, "content").select("dl").where("dl > 0")
    size = F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    corpus = lengths.agg(size.alias("corpus")).scalar()
    seen = counts if small else counts.join(wanted, "token", "left_semi")
    frequency = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = scoring.bm25_weight(
        F.col("tf"), F.col("df"), F.col("dl"), corpus["n"], corpus["avgdl"], k1, b
    )
    return _ranked(counts, asked.join(hint(frequency), "token"), small, weight, k)


def rank_tf_dot(questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``sparse_tf_dot`` over a stored term index (see ``indexing.postings``)."""
    asked = question_terms(questions)
    weight = F.col("qw") * (F.col("tf") / F.col("max_tf"))
    return _ranked(index, asked, fits_broadcast(asked), weight, k)


def rank_bm25(
    questions: DataFrame, index: DataFrame, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """``sparse_bm25`` over a stored term index; texts are not read again."""
    asked = question_terms(questions).drop("qw")
    small = fits_broadcast(asked)
    hint = F.broadcast if small else (lambda df: df)
    per_chunk = index.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    size = F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    corpus = per_chunk.agg(size.alias("corpus")).scalar()
    wanted = asked.select("token").distinct()
    frequency = (
        index.join(hint(wanted), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    weight = scoring.bm25_weight(
        F.col("tf"), F.col("df"), F.col("dl"), corpus["n"], corpus["avgdl"], k1, b
    )
    return _ranked(index, asked.join(hint(frequency), "token"), small, weight, k)


# --------------------------------------------------------------------------- dense


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Top-k rows per question by (score desc, id asc)."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if q.size else np.array([], int)
    position = np.arange(q.size) - np.repeat(first, np.diff(np.r_[first, q.size]))
    keep = position < k
    return q[keep], ids[keep], s[keep]


def _dense_block(
    chunks: DataFrame, names: pa.Array, vectors: np.ndarray, bounds: np.ndarray | None, k: int,
    query_type: str,
) -> DataFrame:
    unit_queries = _unit(vectors)
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    shared = chunks.sparkSession.sparkContext.broadcast((names, unit_queries, bounds))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_names, queries, not_after = shared.value
        best = (np.array([], int), None, np.array([], float))
        id_kind = None
        floor = np.full(len(query_names), -np.inf)
        for batch in batches:
            vectors_in = batch.column(batch.schema.get_field_index("vector"))
            # a vector with a gap, or of another length than the questions', has no cosine with them
            valid = np.asarray(vectors_in.value_lengths().fill_null(-1)) == queries.shape[1]
            flat = vectors_in.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(int(valid.sum()), -1) if valid.any() else flat.reshape(0, queries.shape[1])
            finite = np.isfinite(rows).all(axis=1)
            valid[np.flatnonzero(valid)[~finite]] = False
            id_kind = batch.column(0).type
            ids = np.asarray(batch.column(0).to_pylist())[valid]
            if not ids.size:
                continue
            rows = _unit(rows[finite])
            times = None
            if not_after is not None:
                at = batch.schema.get_field_index("created_us")
                times = np.asarray(batch.column(at).to_numpy(zero_copy_only=False))[valid]
            step = max(1, 4_000_000 // max(1, len(query_names)))
            for start in range(0, ids.size, step):
                part = slice(start, start + step)
                scores = np.round(rows[part] @ queries.T, 9)
                if times is not None:
                    scores[~(times[part][:, None] <= not_after[None, :])] = -np.inf
                cut = np.maximum(floor, np.partition(scores, -k, axis=0)[-k]) if (
                    scores.shape[0] > k
                ) else floor
                r, q = np.nonzero((scores >= cut) & (scores > -np.inf))
                if not r.size:
                    continue
                new_ids = ids[part][r]
                all_ids = new_ids if best[1] is None else np.r_[best[1], new_ids]
                best = _best(np.r_[best[0], q], all_ids, np.r_[best[2], scores[r, q]], k)
                counts = np.bincount(best[0], minlength=len(query_names))
                ends = np.cumsum(counts) - 1
                full = counts >= k
                floor[full] = best[2][ends[full]]
        if best[1] is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    query_names.take(pa.array(best[0])),
                    pa.array(best[1].tolist(), type=id_kind),
                    pa.array(best[2]),
                ],
                names=["query_id", "chunk_id", "score"],
            )

    columns = ["chunk_id", "vector"] + (["created_us"] if bounds is not None else [])
    return chunks.select(*columns).mapInArrow(
        rank, f"query_id {query_type}, chunk_id {id_type}, score double"
    )


def _dense_partials(queries: DataFrame, rows: pa.Table, chunks: DataFrame, k: int) -> list[DataFrame]:
    query_type = queries.schema["query_id"].dataType.simpleString()
    lengths = np.asarray(rows.column("vector").combine_chunks().value_lengths().fill_null(0)) if rows.num_rows else []
    parts = []
    for length in sorted({int(n) for n in lengths} - {0}):  # vectors of different lengths have no chunks in common
        own = rows.filter(pa.array(lengths == length)).combine_chunks()
        names, vectors = (own.column(c).chunk(0) for c in ("query_id", "vector"))
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, length)
        finite = np.isfinite(matrix).all(axis=1)
        if not finite.any():
            continue
        bounds = own.column("not_after_us").to_numpy()[finite] if "not_after_us" in queries.columns else None
        parts.append(_dense_block(chunks, names.filter(pa.array(finite)), matrix[finite], bounds, k, query_type))
    return parts


def dense_cosine(
    queries: DataFrame, chunks: DataFrame, k: int, block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact top-k chunks per question by cosine, without pairing the two tables.

    Up to ``block`` questions (``query_id, vector[, not_after]``) travel to the chunks.  Each task
    multiplies its Arrow batches with them and keeps k rows per question, so k rows per
    question and partition are shuffled.  More questions meet the chunks over a pivot index
    (see ``pivots``) in one plan, whatever their number.  Scores are rounded to 9 places so
    that equal vectors tie and the tie goes to the smaller id.
    """
    chunk_columns = ["chunk_id", F.col("vector").cast("array<double>").alias("vector")]
    query_columns = ["query_id", F.col("vector").cast("array<double>").alias("vector")]
    if "not_after" in queries.columns:
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        query_columns.append(F.coalesce(micros("not_after"), F.lit(2**63 - 1)).alias("not_after_us"))
        chunk_columns.append(F.coalesce(micros("created_at"), F.lit(2**63 - 1)).alias("created_us"))
    asked = queries.select(*query_columns).distinct()
    rows = asked.limit(block + 1).toArrow().combine_chunks()
    if rows.num_rows > block:
        from loglattice.operators import pivots

        root = f"{shared_dir(chunks.sparkSession)}/pivots-{uuid.uuid4().hex}"
        pivots.build(chunks, root)
        return pivots.nearest(queries, root, k)
    parts = _dense_partials(asked, rows, chunks.select(*chunk_columns), k)
    if not parts:
        kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"))}
        empty = chunks.sparkSession.createDataFrame(
            [], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
        )
        parts = [empty]
    scored = reduce(DataFrame.unionByName, parts)
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def dense_by_source(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``dense_cosine`` where each question may name its own ``source_filters``.

    Chunks are ranked source by source for the questions that name the source, and the best of
    a question's sources are merged, so a source's chunks are read once however many questions
    name it.  Sources are connectors, of which there are a handful; names that no chunk has are
    left out.  A question without a list, or with an empty one, meets all chunks.
    """
    if "source_filters" not in queries.columns:
        return dense_cosine(queries, chunks, k)
    named = queries.select(F.explode("source_filters").alias("source_type")).distinct()
    held = chunks.select("source_type").distinct().join(named, "source_type", "left_semi")
    parts = [(queries.where(any_source("source_filters")), chunks)]
    for source in sorted(r["source_type"] for r in held.collect()):
        wants = F.array_contains("source_filters", F.lit(source))
        parts.append((queries.where(wants), chunks.where(F.col("source_type") == source)))
    found = [dense_cosine(asked.drop("source_filters"), own, k).drop("rank") for asked, own in parts]
    return top_k(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


# --------------------------------------------------------------------------- fusion


def fuse(dense: DataFrame, sparse: DataFrame, weights: DataFrame, k: int = scoring.WRRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings ``(query_id, chunk_id, rank)``."""
    left = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    right = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    return (
        left.join(right, ["query_id", "chunk_id"], "full_outer")
        .join(weights.select("query_id", "w_dense", "w_sparse"), "query_id")
        .withColumn(
            "score",
            F.round(
                scoring.wrrf_term(F.col("w_dense"), F.col("dense_rank"), k)
                + scoring.wrrf_term(F.col("w_sparse"), F.col("sparse_rank"), k),
                12,
            ),
        )
        .drop("w_dense", "w_sparse")
    )


def rerank(
    candidates: DataFrame, scorer: Callable[[Column, Column], Column] = scoring.token_overlap
) -> DataFrame:
    """Score (question, content) pairs with a supplied Column function or pandas UDF."""
    return candidates.withColumn(
        "cross_encoder_score", scorer(F.col("question"), F.col("content")).cast("double")
    )


def authority_rank(candidates: DataFrame, k: int) -> DataFrame:
    """Final order per question after tier, acceptance, status and recency factors."""
    final = scoring.authority_score(
        F.col("score"), F.col("cross_encoder_score"), F.col("authority_tier"),
        F.col("is_accepted_answer"), F.col("resolution_status"), F.col("recency_score"),
    )
    scored = candidates.withColumn("final_score", F.round(final, 9))
    return top_k(scored, ["query_id"], [F.desc("final_score"), F.asc("chunk_id")], k)


def top_pairs(ranked: DataFrame, k: int) -> DataFrame:
    """Ordered pairs among the first k chunks of each question, k(k-1)/2 at most."""
    listed = (
        ranked.where(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("items"))
    )
    pairs = F.flatten(
        F.transform(
            "items",
            lambda a, i: F.transform(
                F.slice("items", i + 2, F.size("items")),
                lambda b: F.struct(a["chunk_id"].alias("left_id"), b["chunk_id"].alias("right_id")),
            ),
        )
    )
    return listed.select("query_id", F.inline(pairs))


def with_fallback(
    queries: DataFrame, kept: DataFrame, fallback: DataFrame, minimum: int = 2, k: int = 4
) -> DataFrame:
    """Examples per question: the kept ones, or the first k static ones if too few were kept.

    ``fallback(position, example_id)`` is a short static list, carried as one array.
    """
    counts = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    judged = queries.select("query_id").join(counts, "query_id", "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= minimum
    good = kept.join(judged.where(enough).select("query_id"), "query_id", "left_semi").select(
        "query_id", "example_id", "rank", F.lit("similar").alias("origin")
    )
    static = [
        r["example_id"] for r in fallback.orderBy("position", "example_id").limit(k).collect()
    ]
    listed = F.array(*[F.lit(e) for e in static]) if static else F.array().cast("array<bigint>")
    filled = judged.where(~enough).select("query_id", F.posexplode(listed)).select(
        "query_id",
        F.col("col").alias("example_id"),
        (F.col("pos") + 1).alias("rank"),
        F.lit("fallback").alias("origin"),
    )
    return good.unionByName(filled)


def select_sentences(
    documents: DataFrame, query_tokens: Column, budget: Column
) -> DataFrame:
    """Sentences with most query tokens until the budget is passed, back in text order.

    Works inside each row: ``documents`` carries ``text`` and the result adds ``compacted``.
    """

    def scored(sentence: Column, at: Column) -> Column:
        hits = F.size(F.array_intersect(query_tokens, tx.tokens(sentence)))
        return F.struct(
            (-hits).alias("o"), at.alias("i"), tx.token_estimate(sentence).alias("n"), sentence.alias("s")
        )

    ranked = F.array_sort(F.transform(tx.sentences(F.col("text")), scored))
    state = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<i:int,s:string>>").alias("kept"),
    )

    def step(acc: Column, item: Column) -> Column:
        stop = acc["done"] | (acc["used"] + item["n"] > budget)
        return F.struct(
            F.when(stop, acc["used"]).otherwise(acc["used"] + item["n"]).alias("used"),
            stop.alias("done"),
            F.when(stop, acc["kept"])
            .otherwise(F.concat(acc["kept"], F.array(F.struct(item["i"].alias("i"), item["s"].alias("s")))))
            .alias("kept"),
        )

    chosen = F.aggregate(ranked, state, step, lambda acc: F.array_sort(acc["kept"]))
    return documents.withColumn("compacted", F.array_join(F.transform(chosen, lambda x: x["s"]), " "))
