"""Text, number and label functions (JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ["interpret", "schema", "plan", "search", "fetch", "extract", "dedup"]


def clean_whitespace(x: Column) -> Column:
    """Runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_name(x: Column) -> Column:
    """Lower case, then trimmed of Unicode white space; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(x), r"(?U)^\s+|\s+$", ""), F.lit(""))


def truncate(x: Column, most: int = 12_000) -> Column:
    """The first `most` characters (never half a character)."""
    return F.left(x, F.lit(most))


def pdf_title(text: Column, url: Column) -> Column:
    """The first non-blank line if it has at most 200 bytes, else the last path segment of the URL, else empty."""
    line = F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1))
    tail = F.substring_index(F.substring_index(F.coalesce(url, F.lit("")), "?", 1), "/", -1)
    return F.when((line != "") & (F.octet_length(line) <= 200), line).otherwise(tail)


def format_2dp(x: Column) -> Column:
    """Two decimals, correctly rounded from the exact binary value."""
    return F.call_function("format_number", x, F.lit("0.00"))


def parse_scores(response: Column, expected: Column) -> Column:
    """Scores from the first [ to the last ]: clamped to 0..1, cut or padded with 0 to `expected`; unparsable: zeros."""
    found = F.from_json(F.regexp_extract(response, r"(?s)\[.*\]", 0), "array<double>")
    clean = F.transform(F.coalesce(found, F.array().cast("array<double>")), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0)))))
    return F.slice(F.concat(clean, F.array_repeat(F.lit(0.0), expected)), F.lit(1), expected)


def query_variations(q: Column) -> Column:
    """Image searches made from one query without a model."""
    low = F.lower(q)
    plain = ~(low.contains("photo") | low.contains("image") | low.contains("picture"))
    sharp = ~(low.contains("high resolution") | low.contains("hd"))
    made = F.array(q, F.when(plain, F.concat(q, F.lit(" photos"))), F.when(plain, F.concat(q, F.lit(" images"))), F.when(sharp, F.concat(q, F.lit(" high resolution"))), F.concat(F.lit("best "), q, F.lit(" pictures")), F.concat(q, F.lit(" examples")))
    return F.array_compact(made)


def cap_queries(queries: Column, original: Column, most: int = 12) -> Column:
    """The original first if it isn't there (whatever its case), `most` at most."""
    there = F.array_contains(F.transform(queries, F.lower), F.lower(original))
    return F.slice(F.when(there, queries).otherwise(F.concat(F.array(original), queries)), 1, most)


def backoff_seconds(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt), F.lit(most))


def format_elapsed(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return F.when(m > 0, F.concat(m.cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def prompt_columns(columns: Column) -> Column:
    """`- name (type[, required]): description` lines of an array of column definitions."""
    line = lambda c: F.concat(F.lit("- "), c["name"], F.lit(" ("), c["type"], F.when(c["required"], ", required").otherwise(""), F.lit("): "), c["description"])
    return F.array_join(F.transform(columns, line), "\n")


def run_status(state: Column) -> Column:
    """The stored status of a pipeline state."""
    return F.when(state.isin("completed", "failed", "cancelled", "paused", "pending"), state).otherwise("running")


def data_url(content: Column, content_type: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(content_type, F.lit("image/jpeg")), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def stringify_cell(data: Column, name: str) -> Column:
    """A field of a JSON object as a cell: strings raw, null or missing empty, anything else compact JSON."""
    return F.coalesce(F.get_json_object(data, f"$['{name}']"), F.lit(""))


def utf8_lossy(content: Column) -> Column:
    """Bytes as text: each longest broken piece of a character becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def decode_strict(body: Column, kinds: dict[str, str]) -> Column:
    """JSON objects as struct<value, error>: every field of kinds {name: type} must be there, not null and of its type.

    error is null, or `not json` (no object, or one that is cut off), `missing: <the first such field>` or `wrong type`;
    value is null then. Fields that kinds doesn't name are passed over. A null body is no JSON.
    """
    value = F.from_json(body, "struct<" + ", ".join(f"`{n}`: {t}" for n, t in kinds.items()) + ">", {"mode": "PERMISSIVE"})
    loose = F.from_json(body, "map<string, string>")
    gone = F.coalesce(*[F.when(F.element_at(loose, n).isNull(), n) for n in kinds])
    wrong = F.coalesce(*[F.when(value[n].isNull(), "wrong type") for n in kinds])
    error = F.when(loose.isNull(), "not json").when(gone.isNotNull(), F.concat(F.lit("missing: "), gone)).otherwise(wrong)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def format_date(at: Column) -> Column:
    """Month/day/year without leading zeros, in the session's time zone."""
    return F.date_format(at, "M/d/yyyy")


def score_percent(score: Column) -> Column:
    """A score of 0 to 1 as whole per cents, halves upward."""
    return F.floor(score * 100 + 0.5)
