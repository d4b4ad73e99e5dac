"""Content digests of rows and of row sets.

A set digest must not need its rows in one place or in one order.  Each row gets a
SHA-256 text; two 60-bit slices of it are summed over the set (exactly, as decimals)
and hashed again with the row count.  The sums combine map-side, so a run holding most
of the rows costs one small partial record per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions.numeric import as_col, canonical_zero, round_significant, rounded_values


def canonical_number(c: Column | str, digits: int = 12) -> Column:
    """Text of the value at so many significant digits; null stays null."""
    return round_significant(canonical_zero(c), digits).cast("string")


def row_sha256(columns: Sequence[Column | str]) -> Column:
    """Each field as its length and text, null as a mark of its own, so that no two rows read alike."""
    def field(c: Column | str) -> Column:
        text = as_col(c).cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("null"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def row_digests(df: DataFrame, digits: int = 12, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and ``_sha``: ``row_sha256`` over all other columns in name order, doubles at so many significant digits.

    Rounding, text and digest are steps over arrays: each value is rounded and put into text once, and the generated code
    stays small however many columns there are (methods beyond 8,000 bytes of code are not compiled by the JVM).
    """
    types = dict(df.dtypes)
    names = sorted(c for c in df.columns if c not in keep)
    doubles, others = [c for c in names if types[c] == "double"], [c for c in names if types[c] != "double"]
    texts = [F.transform(rounded_values(F.array(*[F.col(f"`{c}`") for c in doubles]), digits), lambda v: v.cast("string"))] if doubles else []
    texts += [F.array(*[F.col(f"`{c}`").cast("string") for c in others])] if others else []
    place = [([*doubles, *others]).index(c) for c in names]
    fields = F.transform(F.concat(*texts), lambda t: F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("null")))
    listed = df.select(*keep, fields.alias("_fields"))
    return listed.select(*keep, F.sha2(F.concat(*[F.col("_fields")[i] for i in place]), 256).alias("_sha"))


def _slice(sha: Column, start: int) -> Column:
    return F.conv(F.substring(sha, start, 15), 16, 10).cast("decimal(38,0)")


def set_sums(sha: Column | str) -> list[Column]:
    """Aggregate expressions (rows, sum_a, sum_b) that add up over parts of a set; sums as decimals."""
    s = as_col(sha)
    sums = [F.coalesce(F.sum(_slice(s, at)), F.lit(0).cast("decimal(38,0)")) for at in (1, 16)]
    return [F.count(F.lit(1)).alias("rows"), sums[0].alias("sum_a"), sums[1].alias("sum_b")]


def set_sha256(sha: Column | str) -> Column:
    """Aggregate expression: order-free digest of a column of row digests."""
    rows, a, b = set_sums(sha)
    return F.sha2(F.concat_ws("|", rows.cast("string"), a.cast("string"), b.cast("string")), 256)


def sums_sha256(rows: int, sum_a: int, sum_b: int) -> str:
    """The same digest from added-up sums."""
    return hashlib.sha256(f"{rows}|{sum_a}|{sum_b}".encode()).hexdigest()
