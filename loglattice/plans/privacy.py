"""Masking and auditing personal data, tagging technical identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import identifiers as ids
from loglattice.functions import masking
from loglattice.plans.registry import query
from loglattice.sources.tables import read_table, spread


def _ascii(pattern: str) -> str:
    return pattern.replace("(?U)", "")


def mask_sql(expression: str) -> str:
    """The masking chain in SQL."""
    for _, pattern, placeholder in masking.PATTERNS:
        expression = f"regexp_replace({expression}, '{_ascii(pattern)}', '{placeholder}', 'g')"
    return expression


@query("mask_documents", f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def mask_documents(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    return docs.select("doc_id", masking.mask_text(F.col("text")).alias("masked"))


# Personal data of the kinds the tables lack, built from row ids.
_PLANTED = [
    ("jwt", "eyJhbGciOi{0}.eyJzdWIi{0}.sig_{0}"),
    ("aws", "AKIAIOSFODNN7EXAMPL{0}"),
    ("hash", "d41d8cd98f00b204e9800998ecf8427{0}"),
    ("phone", "+1-800555123{0}"),
    ("v6", "2001:0db8:85a3:0000:0000:8a2e:0370:733{0}"),
]


def _planted_sql(text: str) -> str:
    return f"'{text.replace('{0}', chr(39) + ' || (page_id % 10) || ' + chr(39))}'"


_PAGE_TEXT = " || ' ' || ".join(_planted_sql(t) for _, t in _PLANTED)


@query(
    "mask_nested_rows",
    f"""SELECT page_id, {mask_sql('url')} AS url, {mask_sql('html')} AS html,
          {mask_sql(_planted_sql(_PLANTED[0][1]))} AS jwt, {mask_sql(_planted_sql(_PLANTED[1][1]))} AS aws,
          {mask_sql(_planted_sql(_PLANTED[2][1]))} || ',' || {mask_sql(_planted_sql(_PLANTED[3][1]))} || ','
            || {mask_sql(_planted_sql(_PLANTED[4][1]))} AS listed,
          {_planted_sql(_PLANTED[2][1])} AS trace_id
        FROM pages""",
)
def mask_nested_rows(spark, folder):
    """Strings inside structs and arrays are masked; numbers and the kept column are not."""
    digit = (F.col("page_id") % 10).cast("string")

    def planted(i: int):
        before, *rest = _PLANTED[i][1].split("{0}")
        parts = [F.lit(before)]
        for piece in rest:
            parts += [digit, F.lit(piece)]
        return F.concat(*parts)

    pages = spread(read_table(spark, folder, "pages"), "page_id")
    nested = pages.select(
        "page_id",
        F.struct(F.col("url"), F.struct(F.col("html"), planted(0).alias("jwt")).alias("inner")).alias("page"),
        F.create_map(F.lit("aws"), planted(1)).alias("extra"),
        F.array(planted(2), planted(3), planted(4)).alias("items"),
        planted(2).alias("trace_id"),
    )
    masked = masking.mask_rows(nested, keep=["trace_id"])
    return masked.select(
        "page_id",
        F.col("page.url").alias("url"),
        F.col("page.inner.html").alias("html"),
        F.col("page.inner.jwt").alias("jwt"),
        F.col("extra")["aws"].alias("aws"),
        F.array_join("items", ",").alias("listed"),
        "trace_id",
    )


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{_ascii(pattern)}'))"


_COUNTS = ", ".join(f"CAST(sum({_count_sql(p)}) AS BIGINT) AS {k}" for k, p, _ in masking.PATTERNS)
_ANY = " + ".join(_count_sql(p) for _, p, _ in masking.PATTERNS)


@query(
    "audit_documents",
    f"""SELECT lang, {_COUNTS}, round(avg(CASE WHEN {_ANY} > 0 THEN 1.0 ELSE 0.0 END), 6) AS leak_rate,
          count(*) AS n_rows FROM documents GROUP BY lang""",
)
def audit_documents(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    return masking.audit(docs, "text", ["lang"]).withColumn("leak_rate", F.round("leak_rate", 6))


@query(
    "audit_after_masking",
    f"""WITH masked AS (SELECT lang, {mask_sql('text')} AS text FROM documents)
        SELECT lang, round(avg(CASE WHEN {_ANY} > 0 THEN 1.0 ELSE 0.0 END), 6) AS leak_rate,
          count(*) AS n_rows FROM masked GROUP BY lang""",
)
def audit_after_masking(spark, folder):
    """The leak rate of masked text, which has to be zero."""
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    masked = docs.select("lang", masking.mask_text(F.col("text")).alias("text"))
    report = masking.audit(masked, "text", ["lang"])
    return report.select("lang", F.round("leak_rate", 6).alias("leak_rate"), "n_rows")


_CARD = _ascii(masking.PATTERNS[3][1])


@query(
    "luhn_cards",
    f"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS number FROM documents),
        digits AS (SELECT *, list_reverse(string_split(regexp_replace(number, '[^0-9]', '', 'g'), '')) AS d FROM found),
        sums AS (SELECT *, list_sum(list_transform(range(1, len(d) + 1), lambda i:
            CASE WHEN i % 2 = 0 THEN CAST(d[i] AS INTEGER) * 2 % 10 + CAST(d[i] AS INTEGER) * 2 // 10
                 ELSE CAST(d[i] AS INTEGER) END)) AS s FROM digits)
        SELECT doc_id, count(*) AS card_like, count(*) FILTER (WHERE s % 10 = 0) AS luhn_valid
        FROM sums GROUP BY doc_id""",
)
def luhn_cards(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    found = masking.card_numbers(F.col("text"))
    counted = docs.select(
        "doc_id",
        F.size(found).cast("bigint").alias("card_like"),
        F.size(masking.card_numbers(F.col("text"), luhn_only=True)).cast("bigint").alias("luhn_valid"),
    )
    return counted.where("card_like > 0")


# ------------------------------------------------------------------------- identifiers

_IP, _TRACE, _HASH, _ERROR = (ids.KINDS[i][1] for i in (0, 1, 2, 4))
_PATH_SQL = r"(?:^|[^<])((?:/[^\s<>]+)+)"


def _text_with_ids(text):
    """Documents plus a log-like line naming a path holding an IP, a span and an error code."""
    n = F.col("doc_id")
    tail = F.concat(
        F.lit("\nread /var/10.0.0."), n % 256, F.lit("/app.log span_id="), F.lpad(F.hex(n), 8, "0"),
        F.lit(" ERR_CONN_"), n % 7, F.lit(" at <b>/tmp/x</b> trace: ab-"), n, F.lit("xyz"),
    )
    return F.concat(text, tail)


_IDS_SQL = """idtext AS (
  SELECT *, text || chr(10) || 'read /var/10.0.0.' || (doc_id % 256) || '/app.log span_id='
      || lpad(to_hex(doc_id), 8, '0') || ' ERR_CONN_' || (doc_id % 7)
      || ' at <b>/tmp/x</b> trace: ab-' || doc_id || 'xyz' AS t FROM documents)"""

# ASCII stand-ins for other letters keep word boundaries where Unicode puts them.
_LETTER = "[^\\x00-\\x7f\\P{L}]"
_T_WORD = f"regexp_replace(t, '{_LETTER}', '_', 'g')"
_T_CODE = f"regexp_replace(t, '{_LETTER}', 'q', 'g')"

# Positions: the text between matches and the matches themselves, summed in order.
_SPLIT_KINDS = [
    (1, "IP_ADDR", _IP, _T_WORD),
    (2, "TRACE_ID", f"(?i){_TRACE}", _T_WORD),
    (3, "HASH", _HASH, _T_WORD),
    (4, "PATH", "(?:/[^\\s<>]+)+", "replace(t, '</', '<' || chr(1))"),
    (5, "ERROR_CODE", _ERROR, _T_CODE),
]


def _spans_sql() -> str:
    parts = []
    for order, kind, pattern, text in _SPLIT_KINDS:
        value = f"regexp_extract(m, '{pattern}', 1)" if kind == "TRACE_ID" else "m"
        parts.append(f"""SELECT doc_id, {order} AS o, '{kind}' AS kind,
            before + length(m) - length({value}) AS s, before + length(m) AS e, {value} AS v FROM (
          SELECT doc_id, m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS BIGINT)
              + coalesce(CAST(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))) AS BIGINT), 0) AS before
          FROM (SELECT doc_id, gaps, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
            SELECT doc_id, regexp_split_to_array({text}, '{pattern.replace("([A", "(?:[A")}') AS gaps,
                   regexp_extract_all({text}, '{pattern}', 0) AS ms FROM idtext)))""")
    return "spans AS (" + "\nUNION ALL ".join(parts) + ")"


def _kept_sql() -> str:
    ctes = ["k1 AS (SELECT * FROM spans WHERE o = 1)"]
    for n in (2, 3, 4, 5):
        ctes.append(
            f"k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM spans x WHERE o = {n} AND NOT EXISTS ("
            f"SELECT 1 FROM k{n - 1} y WHERE y.doc_id = x.doc_id AND x.s < y.e AND y.s < x.e))"
        )
    return ",\n".join(ctes)


TAGGED = f"""{_IDS_SQL}, {_spans_sql()}, {_kept_sql()},
pieces AS (
  SELECT k5.doc_id, k5.s, substr(t, CAST(lag(e, 1, 0) OVER w + 1 AS BIGINT), CAST(s - lag(e, 1, 0) OVER w AS BIGINT))
      || '<' || kind || ':' || v || '>' AS piece, max(e) OVER (PARTITION BY k5.doc_id) AS last_end
  FROM k5 JOIN idtext USING (doc_id) WINDOW w AS (PARTITION BY k5.doc_id ORDER BY s)),
tagged AS (
  SELECT i.doc_id, string_agg(piece, '' ORDER BY s) || substr(any_value(t), CAST(max(last_end) + 1 AS BIGINT)) AS tagged
  FROM idtext i JOIN pieces p ON p.doc_id = i.doc_id GROUP BY i.doc_id)"""


@query("tag_identifiers", f"WITH {TAGGED} SELECT doc_id, tagged FROM tagged")
def tag_identifiers(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    return docs.select("doc_id", ids.tag_identifiers(_text_with_ids(F.col("text"))).alias("tagged"))


@query(
    "tag_single_kind",
    f"""WITH {_IDS_SQL} SELECT doc_id, regexp_replace(t, '{_IP}', '<IP_ADDR:\\0>', 'g') AS tagged FROM idtext""",
)
def tag_single_kind(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    tagged = ids.tag_single(_text_with_ids(F.col("text")), "IP_ADDR")
    return docs.select("doc_id", tagged.alias("tagged"))


_EXTRACTS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all({text}, '{pattern}', {group})) AS value FROM idtext"
    for kind, pattern, group, text in (
        ("IP_ADDR", _IP, 0, _T_WORD), ("TRACE_ID", f"(?i){_TRACE}", 1, _T_WORD),
        ("HASH", _HASH, 0, _T_WORD), ("PATH", _PATH_SQL, 1, "t"), ("ERROR_CODE", _ERROR, 0, _T_CODE),
    )
)


@query("extract_identifiers", f"WITH {_IDS_SQL} {_EXTRACTS}")
def extract_identifiers(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    found = docs.select("doc_id", ids.extract_all(_text_with_ids(F.col("text"))).alias("found"))
    return found.select("doc_id", F.inline("found"))


@query(
    "lost_tags",
    f"""WITH {_IDS_SQL},
        pair AS (SELECT doc_id, regexp_replace(t, '{_IP}', '<IP_ADDR:\\0>', 'g') AS original FROM idtext),
        cut AS (SELECT *, original[: CAST(floor(length(original) * (60 + doc_id % 41) / 100) AS BIGINT)] AS compacted FROM pair)
        SELECT DISTINCT doc_id, tag FROM (
          SELECT doc_id, compacted, unnest(regexp_extract_all(original, '{ids.TAG}')) AS tag FROM cut)
        WHERE NOT list_contains((SELECT regexp_extract_all(compacted, '{ids.TAG}')), tag)""",
)
def lost_tags(spark, folder):
    """Address tags cut off by a shortened text."""
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    original = docs.select(
        "doc_id", ids.tag_single(_text_with_ids(F.col("text")), "IP_ADDR").alias("original")
    )
    share = F.floor(F.length("original") * (60 + F.col("doc_id") % 41) / 100).cast("int")
    cut = original.withColumn("compacted", F.left("original", share))
    return cut.select("doc_id", F.explode(ids.lost_tags(F.col("original"), F.col("compacted"))).alias("tag"))
