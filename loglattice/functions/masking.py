"""Personal-data masking and auditing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.text import let

# Kinds in order of application, pattern, and placeholder.
# (?U) gives digits, spaces and word boundaries their Unicode meaning.
PATTERNS = [
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<JWT_TOKEN>"),
    ("aws_key", r"AKIA[0-9A-Z]{16}", "<AWS_KEY>"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
    ("card", r"(?U)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}\b", "<CREDIT_CARD>"),
    ("ipv4", r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP_ADDRESS>"),
    ("ipv6", r"(?U)\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "<IP_ADDRESS>"),
    ("sha256", r"(?U)\b[a-fA-F0-9]{64}\b", "<HASH>"),
    ("md5", r"(?U)\b[a-fA-F0-9]{32}\b", "<HASH>"),
    ("phone", r"(?U)\+\d{1,3}[\s-]?\d{6,14}", "<PHONE>"),
]

# A text without this literal cannot match the kind, so its regex is not run.
NEEDS = {"jwt": "eyJ", "aws_key": "AKIA", "email": "@", "ipv6": ":", "phone": "+"}


def _apply(kind: str, pattern: str, placeholder: str) -> Callable[[Column], Column]:
    return lambda text: F.when(
        F.contains(text, F.lit(NEEDS[kind])), F.regexp_replace(text, pattern, placeholder)
    ).otherwise(text)


def mask_text(text: Column) -> Column:
    """All patterns in order."""
    for kind, pattern, placeholder in PATTERNS:
        if kind in NEEDS:
            text = let(text, _apply(kind, pattern, placeholder))
        else:
            text = F.regexp_replace(text, pattern, placeholder)
    return text


def _masked(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return mask_text(value)
    if isinstance(data_type, T.StructType):
        parts = [
            _masked(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: _masked(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, v: _masked(v, data_type.valueType))
    if isinstance(data_type, T.VariantType):
        return _masked_variant(value)
    return value


# The parts of a JSON text: a key with its colon, a string value, or what lies between.
JSON_PART = r'"(?:[^"\\]|\\.)*+"\s*+:|"(?:[^"\\]|\\.)*+"|[^"]+'


def _masked_variant(value: Column) -> Column:
    """String values of a VARIANT masked, keys and numbers kept; its dates come back as text."""

    def part(item: Column) -> Column:
        inner = F.from_json(F.concat(F.lit("["), item, F.lit("]")), "array<string>")[0]
        listed = F.to_json(F.array(mask_text(inner)))
        quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
        return F.when(F.endswith(item, F.lit('"')), quoted).otherwise(item)

    parts = F.regexp_extract_all(F.to_json(value), F.lit(JSON_PART), F.lit(0))
    return F.parse_json(F.array_join(F.transform(parts, part), ""))


def _has_text(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(_has_text(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _has_text(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _has_text(data_type.valueType)
    return isinstance(data_type, (T.StringType, T.VariantType))


def mask_rows(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Mask every string at any depth; columns in ``keep`` and non-strings pass through."""
    kept = set(keep)
    return df.select(
        *[
            _masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            if f.name not in kept and _has_text(f.dataType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def findings(text: Column, kind: str) -> Column:
    """Number of matches of one kind."""
    pattern = next(p for k, p, _ in PATTERNS if k == kind)
    count = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), count).otherwise(0) if kind in NEEDS else count


def luhn_valid(number: Column) -> Column:
    """Checksum test of a card-like number; separators are ignored."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    values = F.transform(
        digits,
        lambda d, i: F.when(
            F.pmod(i, F.lit(2)) == 1,
            F.pmod(d.try_cast("int") * 2, F.lit(10)) + F.floor(d.try_cast("int") * 2 / 10),
        )
        .otherwise(d.try_cast("int"))
        .cast("int"),
    )
    total = F.aggregate(values, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.pmod(total, F.lit(10)) == 0


def card_numbers(text: Column, luhn_only: bool = False) -> Column:
    """Card-like numbers in a text, optionally only those passing the checksum."""
    pattern = next(p for k, p, _ in PATTERNS if k == "card")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(found, luhn_valid) if luhn_only else found


def audit(df: DataFrame, text: str, group: Iterable[str] = ()) -> DataFrame:
    """Matches per kind, and the share of rows holding any, per group."""
    counts = df.select(*group, *[findings(F.col(text), k).alias(k) for k, _, _ in PATTERNS])
    hit = sum((F.col(k) for k, _, _ in PATTERNS), F.lit(0)) > 0
    return counts.groupBy(*group).agg(
        *[F.sum(k).alias(k) for k, _, _ in PATTERNS],
        F.avg(hit.cast("double")).alias("leak_rate"),
        F.count(F.lit(1)).alias("n_rows"),
    )
