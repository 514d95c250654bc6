"""Log-search predicates as Columns, plus a nested-dict form of the same algebra.

Every builder returns a boolean Column, so filters reach the scan.  Column names may
be dotted log fields (``service.name``): a flat column of that name wins, otherwise
the name is read as a struct path.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timedelta
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"


def field(name: str, schema: T.StructType | None = None) -> Column:
    """Column for a possibly dotted log field."""
    if schema is not None and name in schema.fieldNames():
        return F.col(f"`{name}`")
    if schema is None and "." not in name:
        return F.col(f"`{name}`")
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


def words(text: Column) -> Column:
    """Lower-cased word tokens of a string column."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def match_all() -> Column:
    return F.lit(True)


def term(col: Column, value: Any) -> Column:
    """Exact, case-sensitive equality."""
    return col == F.lit(value)


def array_term(col: Column, value: Any) -> Column:
    """Exact equality against any element of an array column."""
    return F.array_contains(col, value)


def terms(col: Column, values: Iterable[Any]) -> Column:
    return col.isin(list(values))


def match(col: Column, query: str) -> Column:
    """Full-text: at least one shared lower-cased word."""
    wanted = sorted({w.lower() for w in re.findall(r"\w+", query)})
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(words(col), F.array(*[F.lit(w) for w in wanted]))


def multi_match(
    schema: T.StructType, query: str, get: Callable[[str], Column] | None = None
) -> Column:
    """Full-text over every string, at any depth of structs, arrays and maps."""
    get = get or (lambda name: F.col(f"`{name}`"))
    return any_of(*[_match_inside(get(f.name), f.dataType, query) for f in schema.fields])


def _match_inside(value: Column, kind: T.DataType, query: str) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(match(value, query), F.lit(False))
    if isinstance(kind, T.StructType):
        return any_of(*[_match_inside(value.getField(f.name), f.dataType, query) for f in kind.fields])
    if isinstance(kind, T.MapType):
        value, kind = F.map_values(value), T.ArrayType(kind.valueType)
    if isinstance(kind, T.ArrayType):
        found = F.exists(value, lambda x: _match_inside(x, kind.elementType, query))
        return F.coalesce(found, F.lit(False))
    return F.lit(False)


def exists(col: Column, is_array: bool = False) -> Column:
    """A value is there; an array needs an element that is not null."""
    if is_array:
        return F.coalesce(F.exists(col, lambda x: x.isNotNull()), F.lit(False))
    return col.isNotNull()


def wildcard(col: Column, pattern: str) -> Column:
    """``*`` matches any run of characters; the whole value must match."""
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%")
    return col.like(escaped)


def between(
    col: Column, gte: Any = None, gt: Any = None, lte: Any = None, lt: Any = None
) -> Column:
    """One- or two-sided range."""
    bounds = [
        (gte, lambda v: col >= v),
        (gt, lambda v: col > v),
        (lte, lambda v: col <= v),
        (lt, lambda v: col < v),
    ]
    return all_of(*[test(_literal(v)) for v, test in bounds if v is not None])


def _literal(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# The time units of relative dates.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "H": 3600, "d": 86400, "w": 604800}
UNIT_MONTHS = {"M": 1, "y": 12}
ROUNDING = {
    "s": "second", "m": "minute", "h": "hour", "H": "hour", "d": "day", "w": "week", "M": "month", "y": "year",
}
STEP = r"[+-]\d{1,9}[smhHdwMy]|/[smhHdwMy]"
RELATIVE = re.compile(rf"^now(?:{STEP})*$")


def relative_time(expression: str, now: datetime) -> datetime:
    """Resolve ``now``, ``now-1h``, ``now/d``, ``now-1M+2d/d`` against an explicit ``now``.

    Steps apply from left to right; a month or year too short for the day ends on its last.
    """
    if not RELATIVE.match(expression):
        raise ValueError(f"not a relative time: {expression!r}")
    moment = now
    for step in re.findall(STEP, expression):
        unit = step[-1]
        if step[0] == "/":
            moment = _rounded_down(moment, unit)
        elif unit in UNIT_MONTHS:
            months = moment.year * 12 + moment.month - 1 + int(step[:-1]) * UNIT_MONTHS[unit]
            year, month = divmod(months, 12)
            day = min(moment.day, monthrange(year, month + 1)[1])
            moment = moment.replace(year=year, month=month + 1, day=day)
        else:
            moment += timedelta(seconds=int(step[:-1]) * UNIT_SECONDS[unit])
    return moment


def _rounded_down(moment: datetime, unit: str) -> datetime:
    if unit == "w":
        moment -= timedelta(days=moment.weekday())
    lowest = {"y": {"month": 1, "day": 1}, "M": {"day": 1}}.get(unit, {})
    clock = {"h": ("minute", "second"), "H": ("minute", "second"), "m": ("second",), "s": ()}
    below = clock.get(unit, ("hour", "minute", "second"))
    return moment.replace(microsecond=0, **{part: 0 for part in below}, **lowest)


def relative_time_column(expression: Column, now: Column) -> Column:
    """The same resolution for a column of expressions (per-row bounds); null for other texts."""

    def amounts(units: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in units.items() for x in pair])

    def step(moment: Column, item: Column) -> Column:
        unit = F.right(item, F.lit(1))
        amount = F.coalesce(F.regexp_extract(item, r"[+-]\d+", 0).try_cast("int"), F.lit(0))
        seconds = F.try_element_at(amounts(UNIT_SECONDS), unit) * amount.cast("long")
        months = F.try_element_at(amounts(UNIT_MONTHS), unit) * amount
        rounded = reduce(
            lambda acc, pair: acc.when(unit == pair[0], F.date_trunc(pair[1], moment)),
            ROUNDING.items(),
            F.when(F.lit(False), moment),
        )
        return (
            F.when(F.startswith(item, F.lit("/")), rounded)
            .when(months.isNotNull(), F.timestamp_add("MONTH", months, moment))
            .otherwise(F.timestamp_micros(F.unix_micros(moment) + seconds * 1_000_000))
        )

    steps = F.regexp_extract_all(expression, F.lit(STEP), F.lit(0))
    moment = F.aggregate(steps, now.cast("timestamp"), step)
    return F.when(expression.rlike(RELATIVE.pattern), moment)


def all_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True)) if clauses else F.lit(True)


def any_of(*clauses: Column) -> Column:
    """At least one clause holds."""
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(False)


def none_of(*clauses: Column) -> Column:
    """Removes only rows that match; a row lacking the field is kept."""
    return all_of(*[~F.coalesce(clause, F.lit(False)) for clause in clauses])


def nested(col: Column, condition: Callable[[Column], Column]) -> Column:
    """Some single element of an array of structs satisfies the whole condition."""
    return F.exists(col, condition)


def as_of(created_at: Column, not_after: Column) -> Column:
    return created_at <= not_after


def in_sources(col: Column, sources: Iterable[str]) -> Column:
    """Source filter; an empty list admits every source."""
    wanted = list(sources)
    return col.isin(wanted) if wanted else F.lit(True)


def at_least(score: Column, threshold: float) -> Column:
    return score >= F.lit(threshold)


def compile_spec(
    spec: Mapping[str, Any], schema: T.StructType, now: datetime | None = None
) -> Column:
    """Column for a nested-dict filter.

    ``{"all": [...]}``, ``{"any": [...]}``, ``{"none": [...]}``, ``{"term": {f: v}}``,
    ``{"terms": {f: [..]}}``, ``{"match": {f: q}}``, ``{"multi_match": q}``,
    ``{"exists": f}``, ``{"wildcard": {f: p}}``, ``{"range": {f: {gte/gt/lte/lt: v}}}``,
    ``{"nested": {path: spec}}``; an empty spec matches everything.
    """
    return _compile(spec, lambda name: field(name, schema), schema, now)


def _bound(value: Any, now: datetime | None, kind: T.DataType | None) -> Any:
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if isinstance(value, str) and (RELATIVE.match(value) or dated and value.startswith("now")):
        if now is None:
            raise ValueError("relative times need an explicit now")
        return relative_time(value, now)
    return value


def _type_of(schema: T.StructType, name: str) -> T.DataType | None:
    current: T.DataType | None = schema
    listed = False  # a field of an array of structs is an array of its values
    for part in [name] if name in schema.fieldNames() else name.split("."):
        if isinstance(current, T.ArrayType):
            current, listed = current.elementType, True
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return T.ArrayType(current) if listed else current


def _any_value(value: Column, kind: T.DataType | None, test: Callable[[Column], Column]) -> Column:
    """The test on a value, or on some element of an array."""
    if isinstance(kind, T.ArrayType):
        return F.exists(value, lambda x: _any_value(x, kind.elementType, test))
    return test(value)


def _leaf(kind: T.DataType | None) -> T.DataType | None:
    return _leaf(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def _typed(value: Any, kind: T.DataType | None) -> Any:
    """Zone-less columns get zone-less bounds, so the comparison still reaches the scan."""
    if isinstance(value, datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value).cast("timestamp_ntz")
    return value


def _element_type(schema: T.StructType, path: str) -> T.StructType:
    current: T.DataType = schema
    names = [path] if path in schema.fieldNames() else path.split(".")
    for name in names:
        current = current[name].dataType  # type: ignore[index]
    if not (isinstance(current, T.ArrayType) and isinstance(current.elementType, T.StructType)):
        raise ValueError(f"{path} is not an array of structs")
    return current.elementType


def _on_element(
    spec: Mapping[str, Any], element: T.StructType, now: datetime | None
) -> Callable[[Column], Column]:
    return lambda x: _compile(spec, x.getField, element, now)


def _compile(
    spec: Mapping[str, Any],
    get: Callable[[str], Column],
    schema: T.StructType,
    now: datetime | None,
) -> Column:
    clauses = []
    for kind, body in spec.items():
        if kind in ("all", "any", "none"):
            parts = [_compile(s, get, schema, now) for s in body]
            clauses.append({"all": all_of, "any": any_of, "none": none_of}[kind](*parts))
        elif kind == "exists":
            clauses.append(exists(get(body), isinstance(_type_of(schema, body), T.ArrayType)))
        elif kind == "multi_match":
            flat = lambda name: get(name) if "." not in name else F.col(f"`{name}`")
            clauses.append(multi_match(schema, body, flat))
        elif kind == "nested":
            for path, inner in body.items():
                element = _element_type(schema, path)
                clauses.append(nested(get(path), _on_element(inner, element, now)))
        elif kind == "range":
            for name, bounds in body.items():
                kind_of = _type_of(schema, name)
                leaf = _leaf(kind_of)
                resolved = {k: _typed(_bound(v, now, leaf), leaf) for k, v in bounds.items()}
                clauses.append(_any_value(get(name), kind_of, partial(between, **resolved)))
        else:
            build = {"term": term, "terms": terms, "match": match, "wildcard": wildcard}[kind]
            for name, value in body.items():
                test = partial(_swapped, build, value)
                clauses.append(_any_value(get(name), _type_of(schema, name), test))
    return all_of(*clauses)


def _swapped(build: Callable[[Column, Any], Column], value: Any, column: Column) -> Column:
    return build(column, value)


def search(df: DataFrame, spec: Mapping[str, Any], now: datetime | None = None) -> DataFrame:
    """Rows of ``df`` matching a nested-dict filter."""
    return df.where(compile_spec(spec, df.schema, now))
