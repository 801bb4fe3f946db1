"""Validation of extracted rows against a user schema: required fields, types, confidence."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.text import format_2dp

#: Fixed value: how a number may be written in a string.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


#: Strings that count as booleans, whatever their case.
BOOLEANS = ["true", "false", "yes", "no", "1", "0"]
#: The messages; %s stands for the column, then the value.
MISSING = "Required column '%s' is missing or empty"
NOT_NUMBER, NOT_NUMBER_TEXT = "Column '%s' expected number", "Column '%s' expected number, got text '%s'"
NOT_A = {"url": "Column '%s' has invalid URL: '%s'", "boolean": "Column '%s' has invalid boolean: '%s'", "email": "Column '%s' has invalid email: '%s'"}
NOT_OBJECT = "Row data is not a JSON object"


class Field(NamedTuple):
    name: str
    type: str = "text"
    required: bool = False
    description: str = ""


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used; a filter on an expression that Spark has
    moved to the scan would compute it for each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _read(f: Field, v: Column) -> Column:
    """A struct of a field: there (present and not null), is_text, text, is_number."""
    path = f"$['{f.name}']"

    def told(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        there = value.isNotNull() & ~F.is_variant_null(value)
        return F.struct(there.alias("there"), (kind == "STRING").alias("is_text"), F.try_variant_get(value, "$", "string").alias("text"), kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)").alias("is_number"))

    return _once(F.try_variant_get(v, path, "variant"), told)


def _said(message: str, name: str, text: Column) -> Column:
    """The message with the column's name and the offending value."""
    before, _, after = message.replace("%s", name, 1).partition("%s")
    return F.concat(F.lit(before), text, F.lit(after))


def _type_issue(f: Field, x: Column) -> Column:
    there, is_text, text, is_number = (x[n] for n in ("there", "is_text", "text", "is_number"))
    if f.type == "number":
        wrong = F.when(is_text & ~text.rlike(NUMBER), _said(NOT_NUMBER_TEXT, f.name, text)).when(~is_text & ~is_number, NOT_NUMBER % f.name)
        return F.when(there, wrong)
    good = {"url": text.startswith("http://") | text.startswith("https://"), "boolean": F.lower(text).isin(*BOOLEANS), "email": text.contains("@") & text.contains(".")}
    if f.type not in good:
        return F.lit(None).cast("string")
    return F.when(there & is_text & ~good[f.type], _said(NOT_A[f.type], f.name, text))


def _required_issue(f: Field, x: Column) -> Column:
    if not f.required:
        return F.lit(None).cast("string")
    return F.when(~F.coalesce(x["there"], F.lit(False)) | (x["is_text"] & (x["text"] == "")), MISSING % f.name)


def validate(rows: DataFrame, fields: list[Field], min_confidence: float = 0.5) -> DataFrame:
    """Adds issues (array) and is_valid to rows (data JSON, confidence, ...): confidence, then required, then types."""
    low = F.when(F.col("confidence") < min_confidence, F.concat(F.lit("Confidence "), format_2dp(F.col("confidence")), F.lit(f" below threshold {min_confidence:.2f}")))

    def issues(x: Column) -> Column:
        each = [made(f, x[f"f{k}"]) for made in (_required_issue, _type_issue) for k, f in enumerate(fields)]
        return F.array_compact(F.array(low, *[F.when(x["is_object"], c) for c in each], F.when(~x["is_object"], NOT_OBJECT)))

    def read(v: Column) -> Column:
        is_object = F.coalesce(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return _once(F.struct(is_object.alias("is_object"), *[_read(f, v).alias(f"f{k}") for k, f in enumerate(fields)]), issues)

    return rows.withColumn("issues", _once(F.try_parse_json(F.col("data")), read)).withColumn("is_valid", F.size("issues") == 0)


def valid_only(validated: DataFrame) -> DataFrame:
    return validated.where("is_valid").drop("issues", "is_valid")
