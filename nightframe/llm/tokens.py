"""Token ids in binary shards, each one wavelet matrix in one compressed file entry.

Documents are dealt by ranges of their id and sorted inside a range, so shards follow each other in
ascending order; a shard ends with the document that brings it to ``SHARD_TOKENS``. The shard table
(``part``, ``seq``, ``n_tokens``, ids and lengths of the documents, the matrix) is written as Parquet
to the shared folder. Reading goes over these files only: ids come back out of the bit planes, and the
start of a shard is the sum of the shards before it.

Id 0 ends every document. A null text is empty and has that id alone. Rows without a document id come
first; repeated rows are documents of their own, next to each other. An empty table has no shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common
from nightframe.llm.pieces import encoder
from nightframe.llm.wavelet import WaveletMatrix

END, SHARD_TOKENS = 0, 1 << 21
_END = np.uint32(END).tobytes()
SHARDS = "part int, seq int, n_tokens long, docs array<bigint>, lengths array<bigint>, matrix binary"


def shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard table, not yet written."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer)
        ids, lengths, coded, held = [], [], [], 0

        def shard():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(coded), "<u4")).to_bytes()
            row = [[part], [seq], [held], [ids], [lengths], [matrix]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "seq", "n_tokens", "docs", "lengths", "matrix"]
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = coder.ids(text or "") + _END
                ids.append(doc)
                lengths.append(len(got) // 4)
                coded.append(got)
                held += len(got) // 4
                if held >= shard_tokens:
                    yield shard()
                    seq, ids, lengths, coded, held = seq + 1, [], [], [], 0
        if ids:
            yield shard()

    rows = common.keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("k_id", "k_text").sortWithinPartitions("k_id", "k_text")
    return common.short_batches(rows.select("doc_id", "text")).mapInArrow(run, SHARDS)


def read_back(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a written shard table."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.asarray(row["lengths"], np.int64)
                stops = np.cumsum(lengths)
                raw = memoryview(WaveletMatrix.from_bytes(row["matrix"]).tokens().astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(lengths.tolist(), stops.tolist(), strict=True)]
                size = len(lengths)
                cols = [
                    pa.array(np.full(size, row["part"], np.int32)),
                    pa.array(np.full(size, row["seq"], np.int32)),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(stops - lengths),
                    pa.array(lengths),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = written.mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    starts = written.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the shards and returns, per document, what reading them gives."""
    return read_back(common.staged(shards(docs, tokenizer), "tokens"))
