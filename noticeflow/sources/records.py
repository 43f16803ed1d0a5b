"""JSON records that differ in their fields: typed columns, and nothing unread is lost.

Each record is one text. A field that a schema has is read as its type; what is not read goes to ``rescued``: fields that the schema lacks, and values that
do not have the type. A text that is no JSON object goes to ``corrupt`` as it is. Built on VARIANT, so a record is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.columns import unused


def _path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _parsed(records: DataFrame, text: str, name: str) -> DataFrame:
    """With a variant of each record that is an object, else null."""
    value = F.try_parse_json(F.col(text))
    return records.withColumn(name, value).withColumn(name, F.when(F.startswith(F.schema_of_variant(F.col(name)), F.lit("OBJECT")), F.col(name)))


def _typed(value: Column, field: T.StructField) -> Column:
    """The field as its type, null where it is not of it; a number with a fraction is no whole number."""
    read = F.try_variant_get(value, _path(field.name), field.dataType.simpleString())
    if not isinstance(field.dataType, T.IntegralType):
        return read
    return F.when(F.try_variant_get(value, _path(field.name), "decimal(38,18)") == read, read)


def read_records(records: DataFrame, schema: T.StructType, text: str = "value", rescued: str = "rescued", corrupt: str = "corrupt") -> DataFrame:
    """``records`` without its text, with the schema's columns, ``rescued`` (JSON or null) and ``corrupt`` (the text or null).

    A field that a record lacks, or has as null, is null. A text that says a number is read as one.
    A null text is a record without fields. Columns of ``records`` keep their place before the schema's.
    """
    value, fields, known = unused([*records.columns, *schema.names, rescued, corrupt], "value", "fields", "known")
    rows = _parsed(records, text, value)
    typed = {f.name: _typed(F.col(value), f) for f in schema.fields}
    rows = rows.withColumn(known, F.struct(*[c.alias(n) for n, c in typed.items()]))
    names = F.array(*[F.lit(n) for n in typed])
    read = F.map_from_arrays(names, F.array(*[F.col(known)[n].isNotNull() for n in typed]))
    rows = rows.withColumn(fields, F.col(value).cast("map<string,variant>"))
    left = F.map_filter(F.col(fields), lambda k, v: ~F.coalesce(F.element_at(read, k), F.lit(False)) & ~F.is_variant_null(v) | ~F.array_contains(names, k))
    out = rows.withColumn(rescued, F.when(F.size(left) > 0, F.to_json(left)))
    out = out.withColumn(corrupt, F.when(F.col(value).isNull(), F.col(text)))
    keep = [c for c in records.columns if c != text]
    return out.select(*keep, *[F.col(known)[n].alias(n) for n in typed], rescued, corrupt)


def fields_of(records: DataFrame, text: str = "value") -> DataFrame:
    """(field, type, n): the fields that records have and their types, from one pass over all of them; nothing is sampled."""
    value, entry = unused(records.columns, "value", "entry")
    rows = _parsed(records, text, value).where(F.col(value).isNotNull()).select(F.col(value).cast("map<string,variant>").alias(entry))
    each = rows.select(F.explode(entry).alias("field", "v"))
    return each.groupBy("field", F.schema_of_variant("v").alias("type")).agg(F.count("*").alias("n"))


#: Kinds of values by what may stand for both of two: the later one in a row.
_NUMBERS = ("BIGINT", "DOUBLE")


def common_type(kinds: list[str]) -> T.DataType:
    """The narrowest type that reads all values of these kinds; text reads any."""
    some = {"DOUBLE" if k.startswith(("DECIMAL", "FLOAT")) else k for k in kinds} - {"VOID"}
    if some <= set(_NUMBERS) and some:
        return T.LongType() if some == {"BIGINT"} else T.DoubleType()
    return {frozenset({"BOOLEAN"}): T.BooleanType(), frozenset({"DATE"}): T.DateType()}.get(frozenset(some), T.StringType())


def discovered_schema(records: DataFrame, text: str = "value") -> T.StructType:
    """A schema of all fields, in order of name; what the driver gets is a row for each field and type."""
    kinds: dict[str, list[str]] = {}
    for r in fields_of(records, text).collect():
        kinds.setdefault(r["field"], []).append(r["type"])
    return T.StructType([T.StructField(n, common_type(k)) for n, k in sorted(kinds.items())])


def written_record(**fields: Column) -> Column:
    """A JSON record of the fields that are not null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
