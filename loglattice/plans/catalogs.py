"""Field catalogs of tables and of daily log indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import text as tx
from loglattice.operators import catalog
from loglattice.operators.retrieval import dense_cosine
from loglattice.plans.ranking import DIMS, _hash_sql
from loglattice.plans.registry import query
from loglattice.plans.views import NOW_SQL, now_column, questions
from loglattice.sources.tables import read_table

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]

_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS index, count(*) AS n_rows FROM {t}" for t in TABLES)


@query(
    "field_catalog",
    f"""WITH counts AS ({_COUNTS})
        SELECT table_name AS index, ordinal_position - 1 AS pos, column_name AS field,
          CASE replace(data_type, '[]', '') WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double'
            WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'keyword' WHEN 'TIMESTAMP' THEN 'date' ELSE data_type END AS type,
          FALSE AS is_nested, CAST(NULL AS VARCHAR) AS nested_path, n_rows
        FROM information_schema.columns JOIN counts ON index = table_name WHERE table_name IN ({_NAMES})""",
)
def field_catalog(spark, folder):
    """Fields and types of every table, with its row count."""
    tables = {t: read_table(spark, folder, t) for t in TABLES}
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("index", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return catalog.field_catalog(tables).join(counts, "index")


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM customer" for c in _CUSTOMER
)


@query(
    "sample_values",
    f"""SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank
          FROM (SELECT field, value, count(*) AS n FROM ({_CELLS}) WHERE value IS NOT NULL GROUP BY field, value)) WHERE rank <= 5""",
)
def sample_values(spark, folder):
    """Five most frequent values of every customer field."""
    return catalog.sample_values(read_table(spark, folder, "customer"))


@query(
    "field_profile",
    f"""SELECT field, count(*) AS n_rows, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS null_share
        FROM ({_CELLS}) GROUP BY field""",
)
def field_profile(spark, folder):
    profiled = catalog.profile(read_table(spark, folder, "customer"))
    return profiled.select("field", "n_rows", F.round("null_share", 6).alias("null_share"))


# Daily indices of the event log: name, fields, last refresh; some are hidden.
INDICES = """named AS (SELECT CASE WHEN user_id % 10 = 0 THEN '.' ELSE '' END || event_type || '-' || strftime(ts, '%Y.%m.%d') AS index,
    max(ts) AS refreshed FROM events GROUP BY 1),
indices AS (SELECT * FROM named WHERE index[1] <> '.'),
fields AS (SELECT index, unnest(['@timestamp', 'service.name', 'took', 'only_' || split_part(index, '-', 1), 'payload.k']) AS field,
    unnest([0, 1, 2, 3, 4]) AS pos,
    unnest(['date', 'keyword', CASE WHEN split_part(index, '-', 1) < 'f' THEN 'double' ELSE 'float' END, 'keyword', 'long']) AS type FROM indices)"""


def _named(spark, folder):
    hidden = F.when(F.col("user_id") % 10 == 0, ".").otherwise("")
    name = F.concat(hidden, F.col("event_type"), F.lit("-"), F.date_format("ts", "yyyy.MM.dd"))
    return read_table(spark, folder, "events").groupBy(name.alias("index")).agg(
        F.max("ts").alias("refreshed")
    )


def _fields(spark, folder):
    kind = F.substring_index("index", "-", 1)
    rows = [
        ("@timestamp", F.lit("date")),
        ("service.name", F.lit("keyword")),
        ("took", F.when(kind < "f", "double").otherwise("float")),
        (None, F.lit("keyword")),
        ("payload.k", F.lit("long")),
    ]
    cells = F.array(
        *[
            F.struct(
                (F.concat(F.lit("only_"), kind) if name is None else F.lit(name)).alias("field"),
                F.lit(pos).alias("pos"),
                type_.alias("type"),
            )
            for pos, (name, type_) in enumerate(rows)
        ]
    )
    return catalog.visible(_named(spark, folder)).select("index", F.inline(cells), "refreshed")


@query("visible_indices", f"WITH {INDICES} SELECT index, strftime(refreshed, '%Y-%m-%d %H:%M:%S') AS refreshed FROM indices")
def visible_indices(spark, folder):
    shown = catalog.visible(_named(spark, folder))
    return shown.select("index", F.date_format("refreshed", "yyyy-MM-dd HH:mm:ss").alias("refreshed"))


# Hints per question; every fifth has none that match, another fifth none at all.
HINTS = """hints AS (SELECT item_id AS query_id, unnest(CASE item_id % 5 WHEN 0 THEN ['error-*', 'view-2024.01.0?']
    WHEN 1 THEN ['purch*.1[1-4]'] WHEN 2 THEN ['[!sve]*-2024.01.2*'] WHEN 3 THEN ['nothing-*'] ELSE [] END) AS hint FROM benchmark)"""
_REGEX = """'^(?s:' || replace(replace(replace(replace(hint, '.', '\\.'), '*', '.*'), '?', '.'), '[!', '[^') || ')$'"""
HINTED = f"""{INDICES}, {HINTS}, hinted AS (SELECT DISTINCT query_id, index FROM hints, indices WHERE regexp_matches(index, {_REGEX}))"""


def _hints(spark, folder):
    empty = F.array().cast("array<string>")
    lists = [["error-*", "view-2024.01.0?"], ["purch*.1[1-4]"], ["[!sve]*-2024.01.2*"], ["nothing-*"], []]
    arrays = [F.array(*[F.lit(h) for h in hints]) if hints else empty for hints in lists]
    chosen = F.element_at(F.array(*arrays), (F.col("query_id") % 5 + 1).cast("int"))
    return questions(spark, folder).select("query_id", F.explode(chosen).alias("hint"))


@query("match_hints", f"WITH {HINTED} SELECT query_id, index FROM hinted")
def match_hints(spark, folder):
    """Index names matching shell patterns."""
    return catalog.match_hints(catalog.visible(_named(spark, folder)), _hints(spark, folder))


@query(
    "index_descriptions",
    f"""WITH {INDICES} SELECT index, 'Index ' || index || '. Fields: ' || string_agg(field, ', ' ORDER BY pos) AS description
        FROM fields GROUP BY index""",
)
def index_descriptions(spark, folder):
    return catalog.describe(_fields(spark, folder))


SIMILAR = f"""descs AS (SELECT index, 'Index ' || index || '. Fields: ' || string_agg(field, ', ' ORDER BY pos) AS description
    FROM fields GROUP BY index),
dv AS (SELECT index, {_hash_sql("description")} AS v FROM descs),
qv AS (SELECT item_id AS query_id, {_hash_sql("text")} AS q FROM benchmark),
similar_raw AS (SELECT query_id, index, round(list_cosine_similarity(v, q), 9) AS score FROM qv, dv),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index) AS rank FROM similar_raw) WHERE rank <= 2)"""


def _similar(spark, folder):
    described = catalog.describe(_fields(spark, folder)).select(
        F.col("index").alias("chunk_id"), tx.hash_vector(F.col("description"), DIMS).alias("vector")
    )
    asked = questions(spark, folder).select(
        "query_id", tx.hash_vector(F.col("question"), DIMS).alias("vector")
    )
    return dense_cosine(asked, described, catalog.SEMANTIC_K).withColumnRenamed("chunk_id", "index")


@query("similar_indices", f"WITH {INDICES}, {SIMILAR} SELECT query_id, index, round(score, 6) AS score, rank FROM near")
def similar_indices(spark, folder):
    """Two indices whose description is closest to the question."""
    return _similar(spark, folder).select("query_id", "index", F.round("score", 6).alias("score"), "rank")


LINKED = f"""{HINTED}, {SIMILAR}, usable AS (SELECT query_id, index FROM near WHERE score >= 0.9),
linked AS (
  SELECT query_id, 'hint' AS step, index FROM hinted
  UNION ALL SELECT query_id, 'similar', index FROM usable WHERE query_id NOT IN (SELECT query_id FROM hinted)
  UNION ALL SELECT item_id, 'all', index FROM benchmark, indices
    WHERE item_id NOT IN (SELECT query_id FROM hinted) AND item_id NOT IN (SELECT query_id FROM usable))"""


def _linked(spark, folder):
    names = catalog.visible(_named(spark, folder))
    hinted = catalog.match_hints(names, _hints(spark, folder))
    similar = _similar(spark, folder).where(F.col("score") >= 0.9)
    return catalog.link(questions(spark, folder), hinted, similar, names)


@query("link_indices", f"WITH {LINKED} SELECT query_id, step, index, CAST(NULL AS VARCHAR) AS error FROM linked")
def link_indices(spark, folder):
    """Hint matches, else similar indices, else all of them."""
    return _linked(spark, folder)


@query(
    "merge_fields",
    f"""WITH {LINKED}, known AS (SELECT item_id AS query_id, unnest(['took', 'extra_' || (item_id % 3)]) AS field FROM benchmark),
        merged AS (SELECT query_id, field, type FROM linked JOIN fields USING (index)
          QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY index, pos) = 1)
        SELECT * FROM merged UNION ALL SELECT query_id, field, 'keyword' FROM known
        WHERE (query_id, field) NOT IN (SELECT (query_id, field) FROM merged)""",
)
def merge_fields(spark, folder):
    """One field list per question; the first index naming a field decides its type."""
    extra = F.array(F.lit("took"), F.concat(F.lit("extra_"), F.col("query_id") % 3))
    known = questions(spark, folder).select("query_id", F.explode(extra).alias("field"))
    return catalog.merge_fields(_linked(spark, folder), _fields(spark, folder), known)


@query(
    "catalog_status",
    f"""WITH {INDICES} SELECT count(DISTINCT f.index) AS index_count, count(*) AS field_count,
          strftime(max(refreshed), '%Y-%m-%d %H:%M:%S') AS last_refreshed,
          epoch_us({NOW_SQL}) - epoch_us(max(refreshed)) > 300000000 AS is_stale FROM fields f JOIN indices USING (index)""",
)
def catalog_status(spark, folder):
    status = catalog.status(_fields(spark, folder), F.col("refreshed"), now_column())
    return status.withColumn("last_refreshed", F.date_format("last_refreshed", "yyyy-MM-dd HH:mm:ss"))
