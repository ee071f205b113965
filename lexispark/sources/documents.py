"""JSON documents as typed columns, with the reason for each rejected document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.mapping import FALSE, TRUE, Field, Mapping

_TYPES = {"text": "string", "keyword": "string", "boolean": "string", "long": "bigint", "double": "double"}


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _number_as_long(text: Column) -> Column:
    """An integer exactly, any other number cut at its point."""
    cut = text.try_cast("double").try_cast("decimal(38,6)")
    cut = F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).otherwise(cut.try_cast("bigint"))


def _coerced(kind: str, json_type: Column, text: Column) -> Column:
    """The value as the field stores it, null where the field doesn't take it."""
    number = json_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind in ("text", "keyword"):
        return F.when(number | json_type.isin("STRING", "BOOLEAN"), text)
    if kind == "boolean":
        return F.when((json_type == "BOOLEAN") | ((json_type == "STRING") & text.isin(*TRUE, *FALSE)), F.when(text.isin(*TRUE), "true").otherwise("false"))
    if kind == "double":
        return F.when(number | (json_type == "STRING"), text.try_cast("double"))
    return F.when(number, _number_as_long(text)).when((json_type == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used: unlike a column, the variable of a lambda isn't
    replaced by its expression when plans are rewritten, as by a filter that moves below a projection."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _field_values(variant: Column, name: str, spec: Field) -> Column:
    """The values of a field as an array, and whether one of them was refused."""
    path = _path(name)
    shape = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    literal = F.get_json_object("_source", path)

    def many(literal: Column) -> Column:
        shapes = F.transform(F.try_variant_get(variant, path, "array<variant>"), lambda v: F.schema_of_variant(v))
        return F.transform(F.arrays_zip(shapes.alias("t"), F.from_json(literal, "array<string>").alias("v")), lambda z: _coerced(spec.type, z["t"], z["v"]))

    def values(read: Column) -> Column:
        one = F.array(_coerced(spec.type, read["shape"], read["literal"]))
        return F.when(read["shape"].isNotNull(), F.when(read["shape"].startswith("ARRAY"), many(read["literal"])).otherwise(one))

    found = _let(F.struct(shape.alias("shape"), literal.alias("literal")), values)
    return _let(found, lambda v: F.struct(v.alias("values"), F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False)).alias("refused")))


def parse(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """``rows`` (with _source) plus an array column per mapped field and _error.

    Unmapped fields are ignored, missing ones are null. A document with a value that its field doesn't take (null and objects
    among them), or that is no JSON object, has _error set and keeps null fields.
    """
    fields = list(mapping.fields.items())

    def read(variant: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
        return F.struct(is_object.alias("is_object"), *[_field_values(variant, name, spec).alias(f"f{i}") for i, (name, spec) in enumerate(fields)])

    def judged(found: Column) -> Column:
        error = F.when(~found["is_object"], F.lit("source isn't a JSON object"))
        for i, (name, spec) in enumerate(fields):
            error = error.when(found[f"f{i}"]["refused"], F.lit(f"failed to parse field [{name}] of type [{spec.type}]"))
        return _let(error, lambda e: F.struct(e.alias("error"), *[F.when(e.isNull(), found[f"f{i}"]["values"]).cast(f"array<{_TYPES[spec.type]}>").alias(f"f{i}") for i, (_, spec) in enumerate(fields)]))

    out = rows.withColumn("_parsed", _let(_let(F.try_parse_json("_source"), read), judged))
    columns = {"_error": F.col("_parsed")["error"]} | {name: F.col("_parsed")[f"f{i}"] for i, (name, _) in enumerate(fields)}
    return out.withColumns(columns).drop("_parsed")
