"""Scalar functions that Spark lacks or spells otherwise, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def regexp_extract(text: Column, pattern: str, group: int = 0) -> Column:
    """The match, or a group of it; null without a match."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), got)


def similar_pattern(pattern: str) -> str:
    """The Java regular expression of an SQL one: % and _ as in LIKE; . ^ $ \\ stand for themselves.

    Inside brackets only the backslash is escaped, so that [^a-z] keeps its meaning.
    """
    java, inside = "", False
    for c in pattern:
        if inside:
            java += "\\\\" if c == "\\" else c
            inside = c != "]"
        else:
            java += {"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$", "\\": "\\\\"}.get(c, c)
            inside = c == "["
    return f"^(?s:{java})$"


def similar_to(text: Column, pattern: str) -> Column:
    """Whole-string match of an SQL regular expression."""
    return text.rlike(similar_pattern(pattern))


def words(text: Column) -> Column:
    """Words between runs of white space, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def str_to_map(text: Column, pairs: str = ";", value: str = ":") -> Column:
    return F.str_to_map(text, F.lit(pairs), F.lit(value))


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def json_exists(text: Column, path: str) -> Column:
    """Whether the path leads somewhere, a JSON null included."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant")).isNotNull(), F.lit(False))


def json_value(text: Column, path: str, kind: str = "string") -> Column:
    """A scalar by path; null if absent or not of the kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def json_query(text: Column, path: str) -> Column:
    """Objects or arrays by path, as JSON text. What a [*] path finds is an array, even of one."""
    got = F.get_json_object(text, path)
    if "[*]" not in path:
        return got
    return F.when(got.isNull() | got.startswith("["), got).otherwise(F.concat(F.lit("["), F.when(got.rlike(r'^(?:[{"]|-?\d|true$|false$|null$)'), got).otherwise(F.concat(F.lit('"'), got, F.lit('"'))), F.lit("]")))


def json_object(**fields: Column) -> Column:
    """JSON text with these keys, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def json_array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def json_objectagg(key: Column, value: Column) -> Column:
    """Aggregate: one JSON object of a group's pairs, by key."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))))


def json_arrayagg(value: Column) -> Column:
    """Aggregate: one JSON array of a group's values, sorted."""
    return F.to_json(F.sort_array(F.collect_list(value)))


def year_week(ts: Column) -> Column:
    """ISO week-year and week, such as 202401."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def convert_tz(ts: Column, source: Column, target: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local time of one zone as text in another; zones may differ by row."""
    return F.date_format(F.convert_timezone(source, target, ts), pattern)


def floor_to(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient toward zero; null where the divisor is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def row_mean(*values: Column) -> Column:
    return reduce(add, values) / len(values)


def row_stdev(*values: Column) -> Column:
    """Sample deviation across the columns of one row."""
    mean = row_mean(*values)
    return F.sqrt(reduce(add, [(x - mean) * (x - mean) for x in values]) / (len(values) - 1))


def millis_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def decode_record(key: Column, value: Column, ms: Column, schema: str) -> Column:
    """A topic record with base64 key and value, decoded."""
    plain = lambda c: F.decode(F.unbase64(c), "utf-8")
    return F.struct(plain(key).alias("key"), F.from_json(plain(value), schema).alias("value"), millis_to_iso(ms).alias("ts"))


def register(spark: SparkSession) -> None:
    """JSON_VALUE, JSON_EXISTS, JSON_QUERY and IS_JSON as SQL functions with literal paths."""
    for name, body in {
        "json_value(j STRING, p STRING) RETURNS STRING": "try_variant_get(try_parse_json(j), p, 'string')",
        "json_exists(j STRING, p STRING) RETURNS BOOLEAN": "coalesce(schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')) IS NOT NULL, false)",
        "json_query(j STRING, p STRING) RETURNS STRING": "get_json_object(j, p)",
        "is_json(j STRING) RETURNS BOOLEAN": "coalesce(try_parse_json(j) IS NOT NULL, false)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
