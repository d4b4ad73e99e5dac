"""Column functions on text, identifiers, times and JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nightframe.functions.numeric import as_col


def strict_boolean(c: Column | str) -> Column:
    """true/false/1/0 in any case and padding; anything else is null."""
    t = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False))


def probability_name(c: Column | str) -> Column:
    slug = F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", "_")
    return F.concat(F.lit("probability_"), F.regexp_replace(slug, "^_+|_+$", ""))


def is_sha256(c: Column | str) -> Column:
    return as_col(c).rlike("^[0-9a-f]{64}$")


def iso_utc(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """a - b in seconds with fractions; null if either side is null."""
    return F.timestamp_diff("MICROSECOND", as_col(b), as_col(a)) / F.lit(1e6)


def comma_join(c: Column | str) -> Column:
    return F.array_join(as_col(c).cast("array<string>"), ",")


def split_id(outer: Column, inner: Column) -> Column:
    return F.format_string("outer_%02d_inner_%02d", outer.cast("int"), inner.cast("int"))


def candidate_id(model: Column, index: Column) -> Column:
    return F.format_string("%s__candidate_%03d", model, index.cast("int"))


def sorted_json(**fields: Column) -> Column:
    """JSON object text with keys in order and no blanks; null fields stay, numbers must be finite."""
    def checked(c: Column) -> Column:
        number = F.typeof(c).isin("double", "float") & c.isNotNull()
        odd = number & (F.isnan(c.try_cast("double")) | (F.abs(c.try_cast("double")) == F.lit(float("inf"))))
        return F.when(odd, F.raise_error(F.lit("JSON has no form for NaN or infinity"))).otherwise(F.lit(None).cast("string"))

    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.coalesce(*[checked(c) for c in fields.values()], text) if fields else text


def recording_parts(c: Column | str) -> dict[str, Column]:
    """The fixed positions of a recording name: id, subject code, subject, night."""
    name = as_col(c)
    return {
        "recording_id": F.substring(name, 1, 6),
        "subject_code": F.substring(name, 4, 2),
        "subject_id": F.substring(name, 4, 2).cast("bigint"),
        "night": F.substring(name, 6, 1).cast("bigint"),
    }
