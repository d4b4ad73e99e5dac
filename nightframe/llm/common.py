"""What the operators share: reading, row keys, words, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The wanted columns and a row key (``k_id``, ``k_text``) without nulls.

    Rows that agree in id and text share a key, and with it every result that depends on
    those two; other columns of the input, whatever their names, are left behind.
    """
    return docs.select(
        *columns,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"),
        F.xxhash64("text").alias("k_text"),
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; ``lower`` does the same where a text is plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """The row key beside each whole row as one struct, whose column names cannot clash with others."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64("text").alias("k_text"), F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    )


def short_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """Sends at most so many rows at a time to Python: texts are long, and workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def with_words(df: DataFrame, text: Column, separators: str, out: str = "words") -> DataFrame:
    """Adds ``out``, the runs between separators: none for null, no empty ones."""
    raw = F.col(f"{out}__raw")
    lead = F.when(raw[0] == "", 1).otherwise(0)
    trail = F.when((F.size(raw) > lead) & (F.try_element_at(raw, F.lit(-1)) == ""), 1).otherwise(0)
    df = df.withColumn(f"{out}__raw", F.split(F.coalesce(text, F.lit("")), separators))
    return df.withColumn(out, F.slice(raw, lead + 1, F.size(raw) - lead - trail)).drop(f"{out}__raw")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes the table to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
