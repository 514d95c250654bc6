"""Context, keyed tables, topology, catalogs, quality, and the skew-safe helpers."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions.text import glob_to_regex
from loglattice.operators import catalog, keyed, quality, scale, topology
from loglattice.operators import context as ctx
from loglattice.operators import logs

T0 = datetime(2026, 1, 1)


def messages(spark, sizes, conv=1):
    rows = [(conv, i, "user", f"msg_{i} " + "x" * n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_last_twenty_at_the_edges(spark):
    kept = ctx.reorder(ctx.last_messages(messages(spark, [0] * 25)), ["conv_id"])
    order = [r["turn"] for r in kept.orderBy("position").collect()]
    assert len(order) == 20 and order[0] == 24 and order[-1] == 23 and set(order) == set(range(5, 25))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_reorder_positions_are_a_permutation(spark, n):
    ranked = spark.range(1, n + 1).select(F.lit(1).alias("g"), F.col("id").alias("rank"))
    assert [r[0] for r in values(ctx.reorder(ranked, ["g"]), "position")] == list(range(n))


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([3, 0, 4, 9, 1, 0])], "g int, i int, t bigint")
    for per_segment in (1, 2, 100):
        kept = ctx.within_budget(df, ["g"], F.floor(F.col("i") / per_segment), [F.asc("i")], F.col("t"), 8)
        assert values(kept, "i", "used") == [(0, 3), (1, 3), (2, 7)]


def test_running_total_of_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("g"), "id", (F.col("id") % 5).alias("v")
    )
    total = scale.running_total(df, ["g"], F.floor(F.col("id") / 64), [F.asc("id")], F.col("v"), "s")
    got = [r[1] for r in values(total.where("g = 0"), "id", "s")]
    assert got == np.cumsum([i % 5 for i in range(1000)]).tolist()
    back = scale.running_total(
        df.where("g = 0"), ["g"], F.floor(F.col("id") / 64), [F.desc("id")], F.col("v"), "s", segment_desc=True
    )
    assert [r[1] for r in values(back, "id", "s")] == np.cumsum([i % 5 for i in range(999, -1, -1)])[::-1].tolist()


@pytest.mark.parametrize("accuracy", [100_000, 50])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, q, accuracy):
    rng = np.random.default_rng(1)
    data = {"hot": rng.exponential(size=2000).round(2), "one": np.array([4.0]), "few": np.array([1.0, 2.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    got = dict(values(scale.exact_percentile(df, ["g"], "v", q, "p", accuracy), "g", "p"))
    assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in data.items()})


def test_size_check(spark):
    df = spark.range(100).withColumn("s", F.lit("x" * 50))
    assert scale.fits_broadcast(df) and not scale.fits_broadcast(df, max_rows=99)
    assert not scale.fits_broadcast(df, max_bytes=1000)


def test_top_k_prunes_before_the_exchange(spark):
    ranked = scale.top_k(spark.range(100).withColumn("g", F.col("id") % 7), ["g"], [F.desc("id")], 3)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_bursts(spark):
    seconds = [0, 299, 598, 898, 898, 2000]
    df = spark.createDataFrame([("u", T0 + timedelta(seconds=s)) for s in seconds], "u string, ts timestamp")
    assert [r[0] for r in values(ctx.bursts(df, ["u"], "ts"), "n_events")] == [1, 2, 3]


def test_tiered_pruning_order(spark):
    rows = [
        (1, "chunk", i, "A", T0 + timedelta(days=i), None, i, 10) for i in range(5)
    ] + [(1, "chunk", 10 + i, "B", T0 + timedelta(days=i), None, i, 10) for i in range(3)] + [
        (1, "log", 20 + i, None, T0 + timedelta(hours=i), "same", 0, 10) for i in range(3)
    ]
    df = spark.createDataFrame(
        rows, "query_id int, kind string, item_id int, tier string, ts timestamp, message string, rank int, tokens bigint"
    )
    kept = lambda budget: {r[0] for r in values(ctx.prune_tiered(df, budget), "item_id")}
    everything = {0, 1, 2, 3, 4, 10, 11, 12, 20, 21, 22}
    assert kept(110) == everything
    assert kept(100) == everything - {10}  # oldest tier-B chunk first
    assert kept(80) == everything - {10, 11, 12}
    assert kept(70) == everything - {10, 11, 12, 21}
    assert kept(50) == {0, 1, 2, 4, 20}
    assert kept(0) == {0, 1, 2, 20}  # items in no wave always stay


def test_assembly(spark):
    def build(memory, fetched, conversation, output, budget):
        row = spark.createDataFrame([(memory, fetched, conversation, output)], "memory string, fetched string, conversation string, output string")
        got = ctx.assemble(row, F.lit(budget)).first()
        return got["context"], got["error"]

    assert build("mem", "doc", "talk", "out", 100) == ("mem\ndoc\ntalk\nout", None)
    assert build("", None, "talk", "", 100) == ("talk\n", None)
    context, error = build("m" * 40, "f", "c", "o" * 8, 11)
    assert context is None and error
    context, _ = build("", "f" * 100, "old " * 20 + "new!", "", 20)
    fetched, talk, _ = context.split("\n")
    assert len(fetched) == 10 * 4 + 3 and len(talk) == 10 * 4 + 3 and talk.endswith("new!")


def test_conversation_tail_keeps_enough(spark):
    df = messages(spark, [30] * 600)
    whole = "\n".join(f"msg_{i} " + "x" * 30 for i in range(600))
    tail = ctx.conversation_tail(df, 50).first()["conversation"]
    assert whole.endswith(tail) and 50 * 4 + 3 <= len(tail) < 300


def test_sufficiency(spark):
    row = spark.range(1)
    enough = lambda *a: row.select(meta.context_sufficient(*[F.lit(x) for x in a])).first()[0]
    assert not enough(True, 0) and enough(False, 0) and enough(True, 2)
    assert not enough(True, 2, True, 0) and not enough(False, 0, False, 0, True, True)


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("count HTTP 500s from payments", (True, False, True, False)),
        ("what is the best practice for node sizing?", (False, True, False, True)),
        ("How to count errors", (False, True, False, True)),
        ("why did the count drop", (True, True, False, True)),
        ("hello", (True, True, False, True)),
        ("account balance", (True, True, False, True)),
    ],
)
def test_routing(spark, question, expected):
    df = spark.createDataFrame([(question,)], "q string")
    assert tuple(df.select(meta.route(F.col("q"))).first()[0]) == expected


# ---------------------------------------------------------------- keyed


@pytest.fixture(scope="module")
def memories(spark):
    rows = [("a", "1", 10, 1), ("a", "2", 10, 2), ("session_abc/x", "v", 5, 3), ("sessionXabc/y", "w", 6, 4), ("empty", "", 7, 5)]
    return keyed.save(spark.createDataFrame(rows, "key string, value string, saved_at bigint, seq int"))


def test_keyed_table(spark, memories):
    assert values(memories, "key", "value")[0] == ("a", "2")
    wanted = spark.createDataFrame([(1, 1, "session_abc/x"), (1, 2, "empty"), (1, 3, "a"), (1, 4, "no")], "request_id int, ask int, key string")
    assert dict(values(keyed.fetch_one(memories, wanted), "key", "value")) == {"a": "2", "empty": "", "no": "", "session_abc/x": "v"}
    assert values(keyed.fetch_prefix(memories, "session_abc"), "key") == [("session_abc/x",)]
    remaining, report = keyed.remove(memories, wanted.where("key in ('a', 'no')").select("key"))
    assert values(report, "key", "found") == [("a", True), ("no", False)] and remaining.count() == 3
    assert [r["key"] for r in keyed.list_keys(memories).collect()] == ["session_abc/x", "sessionXabc/y", "empty", "a"]
    found = keyed.number(keyed.fetch_many(memories, wanted), "request_id", "ask")
    assert keyed.render_xml(found, "request_id").first()["xml"] == (
        '<memories>\n  <memory key="session_abc/x">v</memory>\n  <memory key="a">2</memory>\n</memories>'
    )


def test_long_requests_come_in_parts(spark):
    rows = spark.range(1, 26).select(F.lit(1).alias("r"), F.col("id").alias("pos"), F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    parts = [r["xml"] for r in keyed.render_xml(rows, "r", rows_per_part=10).orderBy("part").collect()]
    whole = keyed.render_xml(rows, "r").first()["xml"]
    assert len(parts) == 3 and "".join(parts) == whole


# ---------------------------------------------------------------- topology


def test_topology(spark):
    edges = spark.createDataFrame([("payments", "db-primary"), ("payments", "auth"), ("gateway", "payments")], "src string, dst string")
    hints = spark.createDataFrame([(1, "payments-*"), (2, "other-*")], "request_id int, hint string")
    assert values(topology.expand_hints(hints, edges), "request_id", "hint") == [
        (1, "auth-*"), (1, "db-primary-*"), (1, "payments-*"), (2, "other-*"),
    ]
    claims = spark.createDataFrame([("payments", "auth"), ("payments", "cache"), ("ghost", "auth")], "src string, dst string")
    reasons = dict((r[0:2], r[2]) for r in values(topology.check_edges(claims, edges).fillna("ok"), "src", "dst", "reason"))
    assert reasons[("payments", "auth")] == "ok"
    assert reasons[("payments", "cache")].startswith("E008") and reasons[("ghost", "auth")].endswith("unknown source")


def test_hypotheses(spark):
    rows = [(1, "a", 3, 9), (1, "b", 0, 1), (1, "c", 1, 5), (1, "d", 0, 4), (1, "e", 1, 9)]
    df = spark.createDataFrame(rows, "query_id int, id string, contradictions int, supporting_evidence_count int")
    ranked = topology.rank_hypotheses(df).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["d", "b", "e"]


# ---------------------------------------------------------------- catalog


def test_field_catalog(spark):
    shaped = spark.createDataFrame([], "service string, http array<struct<status_code:int>>, a struct<b:struct<c:string>>")
    rows = values(catalog.field_catalog({"logs": shaped, ".hidden": shaped}), "field", "type", "is_nested", "nested_path")
    assert rows == [
        ("a", "object", False, None), ("a.b", "object", False, None), ("a.b.c", "keyword", False, None),
        ("http", "nested", True, "http"), ("http.status_code", "integer", False, "http"),
        ("service", "keyword", False, None),
    ]


@pytest.mark.parametrize(
    ("pattern", "name", "matches"),
    [
        ("payments-*", "payments-2026.04", True),
        ("payments-*", "auth-2026.04", False),
        ("pay?ents", "payments", True),
        ("a.b", "axb", False),
        ("[ap]*", "auth", True),
        ("[!ap]*", "auth", False),
        ("*", "", True),
        ("x(1)", "x(1)", True),
    ],
)
def test_glob(spark, pattern, name, matches):
    df = spark.createDataFrame([(pattern, name)], "p string, n string").withColumn("r", glob_to_regex(F.col("p")))
    assert df.select(F.expr("n rlike r")).first()[0] is matches


def test_link_steps_and_empty_catalog(spark):
    pairs = "query_id int, index string"
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    indices = spark.createDataFrame([("a",), ("b",)], "index string")
    hinted = spark.createDataFrame([(1, "a")], pairs)
    similar = spark.createDataFrame([(1, "b"), (2, "b")], pairs)
    got = values(catalog.link(queries, hinted, similar, indices), "query_id", "step", "index")
    assert got == [(1, "hint", "a"), (2, "similar", "b"), (3, "all", "a"), (3, "all", "b")]
    nothing = spark.createDataFrame([], pairs)
    errors = catalog.link(queries, nothing, nothing, indices.where("false"))
    assert values(errors, "error") == [("E001",)] * 3


def test_status_goes_stale(spark):
    df = spark.createDataFrame([("a", T0)], "index string, at timestamp")
    stale = lambda s: catalog.status(df, F.col("at"), F.lit(T0 + timedelta(seconds=s))).first()["is_stale"]
    assert not stale(300) and stale(301)


# ---------------------------------------------------------------- logs and quality


def test_hits(spark):
    flat = spark.createDataFrame([("pay", None, "x")], "`service.name` string, service string, level string")
    assert tuple(logs.normalise_hits(flat).first()) == (None, "pay", "x", None, None)
    nested = spark.createDataFrame([(("pay",), "m")], "service struct<name:string>, message string")
    assert tuple(logs.normalise_hits(nested).first()) == (None, "pay", None, "m", None)
    assert [logs.result_size(n) for n in (None, 0, 10, 5000)] == [500, 500, 10, 2000]


@pytest.mark.parametrize(
    ("kql", "error"),
    [
        ("(a: 1)", None),
        ("(a: 1", "Unclosed '(' at position 0."),
        ("a: 1)", "Unexpected closing ')' at position 4."),
        ("u:{ a (b }", "Mismatched bracket: opened with '(' at position 6 but closed with '}' at position 9."),
        ("((a) {b}", "Unclosed '(' at position 0."),
    ],
)
def test_brackets(spark, kql, error):
    df = spark.createDataFrame([(kql,)], "kql string")
    assert df.select(quality.bracket_error(F.col("kql"))).first()[0] == error


@pytest.mark.parametrize(
    ("kql", "valid"),
    [
        ('service.name: "payments" AND level: "ERROR"', True),
        ("NOT level: debug", True),
        ("", False),
        ("a: 1 AND AND b: 2", False),
        ("a: 1 or and b: 2", False),
        ("AND a: 1", False),
        ("a: 1 NOT", False),
        ("a: AND b: 1", False),
        ("a:", False),
        ('a: ""', True),
    ],
)
def test_lint(spark, kql, valid):
    df = spark.createDataFrame([(1, kql)], "query_id int, kql string")
    assert quality.lint(df).first()["valid"] is valid


def test_lint_unknown_fields(spark):
    df = spark.createDataFrame([(1, "bogus: 1 AND bogus > 2 AND ok: 3"), (2, "bogus: 1")], "query_id int, kql string")
    fields = spark.createDataFrame([(1, "ok")], "query_id int, field string")
    got = {r["query_id"]: r["errors"] for r in quality.lint(df, fields).collect()}
    assert got == {1: ["Field 'bogus' not found in schema."], 2: []}


def test_retrieval_quality(spark):
    ranking = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 9, 3), (3, 1, 1)], "query_id int, doc_id int, rank int")
    truth = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (4, 1)], "query_id int, doc_id int")
    got = quality.retrieval_quality(ranking, truth, 3).first()
    assert (got["n_queries"], got["n_true"], got["n_found"]) == (3, 4, 2)
    assert got["recall"] == pytest.approx((0.5 + 1 + 0) / 3) and got["mrr"] == pytest.approx((1 / 2 + 1 / 3) / 3)
