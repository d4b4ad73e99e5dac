"""Quality rules as a bitmask ledger: measure once, decide as often as wanted.

``ledger`` reads every text once and stores its measurements and one failure bit per rule. A policy is
a version name with the set of rules that it obeys, as a mask; a document is kept when none of the
policy's bits is set. Ablations (what each rule alone rejects, what a policy would keep without it)
are sums over the stored bits and never touch the texts again.

A null text has no words and fails the base rules, as an empty one does. Rows are judged one by one,
so repeated rows and ties have equal verdicts; an empty table gives an empty ledger and ablation
counts of zero. Columns other than id and text are left alone.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from nightframe.llm import common

#: name -> failure condition over the measurements, in the order of the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_shouted > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "capitals": "2 * n_capitals > n_words",
    "duplicate_lines_third": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated_words")
#: Versions of the policy; a later one never changes an earlier one.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines_third"),
    "v2": (*BASE, "symbols", "shouting", "duplicate_lines", "word_length"),
    "v3": (*BASE, "symbols", "capitals", "duplicate_lines", "word_length"),
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_shouted", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\v\f\r"


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measure(data: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    data = data or b""
    words = data.split()  # ASCII white space only
    text = data.decode("utf-8", "replace")
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [line for line in data.split(b"\n") if line.split()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(triples)
    repeated = 0
    if len(seen) < len(triples):
        upto = 0  # words before this place are counted
        for at, triple in enumerate(triples):
            if seen[triple] > 1:
                repeated += at + 3 - max(at, upto)
                upto = at + 3
    shouted = sum(1 for w in words if w.endswith(b"!!")) if b"!!" in data else 0
    # words of more than one byte with capital but no small letters of the ASCII range
    capitals = sum(1 for w in words if w.isupper() and len(w) > 1)
    return len(words), chars, sum(map(text.count, SYMBOLS)), shouted, len(lines), len(lines) - len(set(lines)), repeated, capitals


def _measured(rows: DataFrame) -> DataFrame:
    """Rows (``row``, any struct or value, and ``text``) as ``row``, the measurements and ``failed``."""

    def run(batches):
        for batch in batches:
            got = [measure(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.list_(pa.int64()))], ["row", "m"])

    out = StructType([rows.schema["row"], StructField("m", ArrayType(LongType()))])
    rows = common.short_batches(rows).mapInArrow(run, out).select("row", *[F.get("m", F.lit(i)).alias(m) for i, m in enumerate(MEASURES)])
    mask: Column = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failed", mask)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed`` (one bit per rule)."""
    return _measured(docs.select(F.col("doc_id").alias("row"), "text")).withColumnRenamed("row", "doc_id")


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rejected by it, by it alone, and documents kept if it were dropped."""
    mask = bits(POLICIES[policy])
    own = F.col("failed").bitwiseAND(F.lit(mask))
    # one row per pattern of bits first, a few dozen at most
    patterns = ledger.groupBy(own.alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    return (
        patterns.select("failed", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when((F.col("failed") == 0) | (F.col("failed") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def verdicts(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed from a (stored) ledger."""
    failed_base = F.col("failed").bitwiseAND(F.lit(bits(BASE))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed_base.alias("base_failed"), (~failed_base & passes(policy)).alias("kept"), "failed"
    )


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The verdicts on documents whose ledger is not stored."""
    return verdicts(ledger(docs), policy)


def accepted(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    rows = docs.select(F.struct(*[common.quoted(c) for c in docs.columns]).alias("row"), "text")
    return _measured(rows).filter(passes("base") & passes(policy)).select("row.*")


_LEDGER = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) > 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri), LATERAL (SELECT unnest([i, i + 1, i + 2]) AS p)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(w, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_shouted,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS BIGINT) AS n_capitals,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_shouted > n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
    + 32 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::INT + 64 * (2 * n_capitals > n_words)::INT
    + 128 * (10 * n_dup_lines > 3 * n_lines)::INT AS BIGINT) AS failed FROM m)
"""
_JUDGED = """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 119) = 0 AS kept, failed FROM b
"""
ORACLE = _LEDGER + _JUDGED
#: The bits of v3 are 119, and its rules these.
ABLATIONS_ORACLE = _LEDGER + """SELECT rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS rejected, count(*) FILTER (WHERE (failed & 119) = bit) AS rejected_alone,
  count(*) FILTER (WHERE (failed & 119) IN (0, bit)) AS kept_without
FROM b, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 16), ('word_length', 32), ('capitals', 64)) r(rule, bit) GROUP BY rule"""
