"""Token counts that follow edits.

Every document keeps a tree over its text: leaves are runs of ``LEAF`` pre-token parts with their
characters and tokens, inner nodes hold sums. An edit replaces the characters [start, stop): the tree
finds the leaves that it touches, the region grows by boundary context (to the nearest cuts that no
pre-token can cross, see ``pieces``), only that region is encoded again, and the sums above it change
by the difference. The count then equals that of encoding the edited text as a whole.

A null text is empty; empty texts have a tree without leaves. Edits apply in order, each to the text
that the last one left; places beyond the end are moved to the end. Rows are independent, so repeated
rows give equal results and an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from nightframe.llm import common
from nightframe.llm.pieces import Encoder, encoder, parts

LEAF = 64


class CountTree:
    """Leaves in blocks of 32 under sums of characters and tokens, two levels below the total."""

    FAN = 32

    def __init__(self, chars: list[int], tokens: list[int]):
        self.blocks = [[chars[i : i + self.FAN], tokens[i : i + self.FAN]] for i in range(0, len(chars), self.FAN)]
        self.sums = [[sum(c), sum(t)] for c, t in self.blocks]
        self.chars, self.tokens = sum(chars), sum(tokens)

    @classmethod
    def build(cls, text: str, coder: Encoder) -> CountTree:
        return cls(*cls._leaves(text, coder))

    @staticmethod
    def _leaves(text: str, coder: Encoder) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run of LEAF parts."""
        own = parts(text)
        chars, tokens = list(map(len, own)), [len(ids) // 4 for ids in map(coder.__getitem__, own)]
        starts = range(0, len(own), LEAF)
        return [sum(chars[i : i + LEAF]) for i in starts], [sum(tokens[i : i + LEAF]) for i in starts]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [c for b in self.blocks for c in b[0]], [t for b in self.blocks for t in b[1]]

    def _locate(self, start: int, stop: int) -> tuple[int, int, int, int]:
        """(first block, last block, characters before the first, tokens of the blocks) around [start, stop]."""
        at, first, before = 0, 0, 0
        while first < len(self.sums) - 1 and at + self.sums[first][0] < start:
            at += self.sums[first][0]
            first += 1
        before, last = at, first
        while last < len(self.sums) - 1 and at + self.sums[last][0] <= stop:
            at += self.sums[last][0]
            last += 1
        return first, last, before, sum(s[1] for s in self.sums[first : last + 1])

    def replace(self, text: str, start: int, stop: int, new: str, coder: Encoder) -> tuple[str, int]:
        """(the edited text, characters encoded for it)."""
        start = max(0, min(start, len(text)))
        stop = max(start, min(stop, len(text)))
        if not self.blocks:
            built = CountTree.build(new, coder)
            self.__dict__.update(built.__dict__)
            return new, len(new)
        # context: back to a cut at or before the edit, on to one behind it
        first, last, before, _ = self._locate(start, stop)
        chars = [c for b in self.blocks[first : last + 1] for c in b[0]]
        tokens = [t for b in self.blocks[first : last + 1] for t in b[1]]
        at, a = before, 0
        while a < len(chars) - 1 and at + chars[a] < start:  # an edit at a leaf's start also touches the leaf before
            at += chars[a]
            a += 1
        end, b = at, a
        while b < len(chars) - 1 and end + chars[b] <= stop:
            end += chars[b]
            b += 1
        end += chars[b]
        edited = text[:start] + new + text[stop:]
        region = text[at:start] + new + text[stop:end]
        # leaves start at cuts of the old text; a cut stays one unless the edit changed the character before it
        while end < len(text) and region and not (text[end] == " " and not region[-1].isspace()) or end < len(text) and not region:
            b += 1
            if b == len(chars):  # the region runs into the next block
                last += 1
                chars += self.blocks[last][0]
                tokens += self.blocks[last][1]
            region += text[end : end + chars[b]]
            end += chars[b]
        chars[a : b + 1], tokens[a : b + 1] = self._leaves(region, coder)
        blocks = [[chars[i : i + self.FAN], tokens[i : i + self.FAN]] for i in range(0, len(chars), self.FAN)]
        sums = [[sum(c), sum(t)] for c, t in blocks]
        self.chars += sum(s[0] for s in sums) - sum(s[0] for s in self.sums[first : last + 1])
        self.tokens += sum(s[1] for s in sums) - sum(s[1] for s in self.sums[first : last + 1])
        self.blocks[first : last + 1], self.sums[first : last + 1] = blocks, sums
        return edited, len(region)


def trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``leaf_chars`` and ``leaf_tokens``, the tree's leaves, to rows with ``text``."""
    schema = docs.schema
    names = [c for c in docs.columns]
    out = type(schema)(list(schema.fields)).add("leaf_chars", ArrayType(LongType())).add("leaf_tokens", ArrayType(LongType()))

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            built = [CountTree.build(t or "", coder).leaves() for t in batch.column("text").to_pylist()]
            coder.tidy()
            more = [pa.array([x[i] for x in built], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, [*names, "leaf_chars", "leaf_tokens"])

    return common.short_batches(docs).mapInArrow(run, out)


def edited(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars, n_leaves.

    Rows: doc_id, text, leaf_chars, leaf_tokens, edits (array of start, stop, new).
    """
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars", "n_leaves"]

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                doc, text, chars, tokens, edits = (x.as_py() for x in row)
                text, tree, again = text or "", CountTree(chars, tokens), 0
                figures = [doc, tree.chars, tree.tokens]
                for e in edits or []:
                    text, coded = tree.replace(text, e["start"], e["stop"], e["new"] or "", coder)
                    again += coded
                out.append((*figures, tree.chars, tree.tokens, again, len(chars)))
            coder.tidy()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names), names)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def sample_edits(docs: DataFrame) -> DataFrame:
    """Adds three edits per document that follow from its own text: a word put in, a span cut, an end rewritten."""
    n, text = F.char_length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), n + 1).cast("int")
    cut = F.pmod(F.xxhash64("doc_id", F.lit(2)), n + 1).cast("int")
    edit = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), new.alias("new"))
    return docs.withColumn(
        "edits",
        F.array(
            edit(start, start, F.concat(F.lit(" "), F.substring(text, 1, 12))),
            edit(cut, cut + 17, F.lit("")),
            edit(n - F.least(n, F.lit(20)), n, F.lit("rewritten end.")),
        ),
    )
