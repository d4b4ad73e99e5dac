"""Removal of bytes covered by strings of ``least`` bytes that also start anywhere else.

Suffixes worth sorting are found first. Every window of ``least`` bytes has an anchor, the place of the
smallest mixed 8-byte word among the first ``least - ANCHOR + 1`` places of the window; equal windows
have equal anchors at equal offsets, so a window can only be repeated if the ``ANCHOR`` bytes at its
anchor are. Anchors are counted over all documents by a 64-bit hash of these bytes (a filter: a
collision costs work, not correctness), and those that occur once are dropped.

The suffixes at the other anchors, with the text before them, are sorted: each task sorts its own into
runs, one per destination, front-codes them and sends them as single blobs; destinations merge the runs
with a loser tree that never compares known prefixes again. Equal suffixes travel once per run, with
their places. Neighbours' common prefixes give what follows an anchor in common with others, the text
before it what precedes; where both make up ``least`` bytes, they are covered.

A group of suffixes with more than ``CROWD`` different surroundings, or ``MEMBERS`` places, would not fit
one destination. Its windows are taken one by one instead: those whose own hash occurs twice are sorted and
merged in the same way, as suffixes of ``least`` bytes with nothing before them, so bytes decide here too. A suffix
with more than ``INLINE`` places in a run sends one mark for them; the places stay beside the run and are joined afterwards.

Null or empty texts have no bytes. Texts are UTF-8 bytes and may be cut inside a character. Repeated
rows are each other's repeats. Ids may be null. An empty table gives no rows.
"""

from __future__ import annotations

import os
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm import common
from nightframe.llm.suffixes import covered, front_code, merge

LEAST, ANCHOR = 400, 128
#: Surroundings, and places, of one group that go to one destination (some 40 and 100 MB at most).
CROWD, MEMBERS = 50_000, 1_000_000
#: Places of one suffix that travel inside a run.
INLINE = 16
#: Hashes that hold more than this part of all repeated places are joined by broadcast: fewer than so many.
HOT = 1000
CHUNK = 1 << 20
#: Suffixes per destination; some hundred bytes each.
PER_DESTINATION = 60_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A reversible mixing of 64-bit words."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _row_hash(rows: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of every row of bytes (row length a multiple of 8)."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), seed, np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h ^ words[:, k]) + np.uint64(k)
    return h


def _low(h: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of hashes: all of them but in tests."""
    return (h & np.uint64(2**bits - 1)).view(np.int64)


def _anchors(raw: np.ndarray, least: int, anchor: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window start, last window start) of every anchor of the windows that are ok; in chunks of windows."""
    reach = least - anchor + 1
    out = []
    for at in range(0, max(0, len(raw) - least + 1), CHUNK):
        part = raw[at : at + CHUNK + least - 1]
        words = np.lib.stride_tricks.sliding_window_view(part, 8)
        h = _mix(np.ascontiguousarray(words).view("<u8").reshape(-1))
        # the place in the low half: the minimum tells where it is, the leftmost one among equals
        h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        low, span = h, 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :]) if span < reach else low
        place = (low[: len(part) - least + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(len(place)) if ok is None else np.flatnonzero(ok[at : at + len(place)])
        place = place[start]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1 if len(first) else first
        out.append((place[first] + at, start[first] + at, start[last] + at))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packs(sizes: list[int], most: int = 2 << 20) -> list[list[int]]:
    """Row numbers in packs of some size, so that many short texts are worked on at once."""
    out, size = [[]], 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


def _places_table(rows: DataFrame, least: int, anchor: int, bits: int) -> DataFrame:
    """hash, around (a hash of the surroundings), k_id, k_text, place of every anchor of every row."""
    names = ["hash", "around", "k_id", "k_text", "place"]

    def run(batches):
        for batch in batches:
            long = [(i, t) for i, t in enumerate(batch.column("raw").to_pylist()) if t is not None and len(t) >= least]
            k_id, k_text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k_id", "k_text"))
            for pack in _packs([len(t) for _, t in long]) if long else []:
                own = [long[i] for i in pack]
                raw = np.frombuffer(b"".join(t for _, t in own), np.uint8)
                ends = np.cumsum([len(t) for _, t in own])
                starts = np.concatenate(([0], ends[:-1]))
                ok = np.zeros(len(raw), bool)
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    ok[a : b - least + 1] = True
                place = np.unique(_anchors(raw, least, anchor, ok)[0])
                doc = np.searchsorted(ends, place, side="right")
                row = np.array([i for i, _ in own])[doc]
                h = _row_hash(np.lib.stride_tricks.sliding_window_view(raw, anchor)[place], 1)
                around = _around(raw, place, starts[doc], ends[doc], least, anchor)
                cols = [_low(h, bits), around.view(np.int64), k_id[row], k_text[row], place - starts[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return common.short_batches(rows).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _around(raw: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, anchor: int) -> np.ndarray:
    """A hash of the text from ``least - anchor`` before to ``least`` after each place, within its document."""
    before, wide = least - anchor, 2 * least - anchor
    wide += -wide % 8
    padded = np.concatenate((np.zeros(before, np.uint8), raw, np.zeros(wide, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)
    lead, tail = np.maximum(0, before - (place - start)), before + np.minimum(end - place, least)
    column = np.arange(wide)
    out = []
    for at in range(0, len(place), 4096):
        part = slice(at, at + 4096)
        inside = (column >= lead[part, None]) & (column < tail[part, None])
        out.append(_row_hash(np.where(inside, view[place[part]], 0), 2))
    ends = lead.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)
    return _mix(np.concatenate(out) ^ ends) if out else np.zeros(0, np.uint64)


def _packed(docs: DataFrame) -> DataFrame:
    """k_id, k_text, doc_id, z: the text's bytes, packed for the way through a shuffle."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            z = [codec.compress(t or b"", asbytes=True) for t in raw]
            sizes = [len(t or b"") for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k_id"), batch.column("k_text"), batch.column("doc_id"), pa.array(z, pa.binary()), pa.array(sizes, pa.int64())],
                ["k_id", "k_text", "doc_id", "z", "n_bytes"],
            )

    return common.short_batches(docs).mapInArrow(run, "k_id long, k_text long, doc_id long, z binary, n_bytes long")


def _windows(rows: DataFrame, least: int, anchor: int, bits: int) -> DataFrame:
    """As ``_places_table``, a row for every window whose anchor is one of the crowds' (``crowd``)."""
    names = ["hash", "around", "k_id", "k_text", "place"]

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(codec.decompress(row["z"], row["n_bytes"], asbytes=True), np.uint8)
                place, first, last = _anchors(raw, least, anchor)
                mine = np.isin(place, np.array(row["crowd"], np.int64))
                starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[mine], last[mine], strict=True)])
                windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(-least % 8, np.uint8))), least + -least % 8)
                for at in range(0, len(starts), 20_000):
                    own = starts[at : at + 20_000]
                    wide = windows[own]
                    wide[:, least:] = 0
                    h = _low(_row_hash(wide, 3), bits)
                    cols = [h, h, np.full(len(own), row["k_id"]), np.full(len(own), row["k_text"]), own]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return rows.select("k_id", "k_text", "z", "n_bytes", "crowd").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _marked(table: DataFrame, crowd: int, members: int) -> DataFrame:
    """The rows whose hash occurs again, with crowded: whether their group is too large for one destination."""
    kinds = table.groupBy("hash", "around").agg(F.count(F.lit(1)).alias("n"))
    again = kinds.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).filter(F.col("n") > 1)
    again = common.staged(again.select("hash", "n", ((F.col("kinds") > crowd) | (F.col("n") > members)).alias("crowded")), "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot, rest = (again.filter(c).select("hash", "crowded") for c in (is_hot, ~is_hot))
    return table.join(F.broadcast(hot), "hash").unionByName(table.join(F.broadcast(hot), "hash", "left_anti").join(rest, "hash"))


def _by_text(marked: DataFrame) -> DataFrame:
    """k_id, k_text, places (place, hash) and crowd (places of groups that are too large), each place once."""
    crowded = F.col("crowded")
    places = F.collect_set(F.when(~crowded, F.struct("place", "hash"))).alias("places")
    return marked.groupBy("k_id", "k_text").agg(places, F.collect_set(F.when(crowded, F.col("place"))).alias("crowd"))


def _runs(rows: DataFrame, destinations: int, least: int, anchor: int) -> DataFrame:
    """dest, blob: a sorted, front-coded run per task and destination; or run, number, k_id, k_text, place: what a mark stands for."""
    schema = "dest int, blob binary, run long, number long, k_id long, k_text long, place long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32(), pa.binary(), *[pa.int64()] * 5]

    def run(batches):
        codec = pa.Codec("zstd")
        held: dict[tuple[bytes, bytes], list] = {}
        size = 0

        def send():
            by_dest: dict[int, list] = {}
            beside: list[tuple] = []
            own = int.from_bytes(os.urandom(7), "little") + 1
            for number, ((key, left), at) in enumerate(sorted(held.items())):
                if len(at) > INLINE:
                    beside.extend((own, number, *x) for x in at)
                    at = [(own, number, -1)]
                by_dest.setdefault(int.from_bytes(key[:8], "big") % destinations, []).append((key, left, at))
            dests = sorted(by_dest)
            blobs = []
            for d in dests:
                data = pickle.dumps(front_code(by_dest[d]), protocol=5)
                blobs.append(len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True))
            nothing = [None] * len(dests)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([dests, blobs, *[nothing] * 5], kinds, strict=True)], names)
            for at in range(0, len(beside), 20_000):
                part = beside[at : at + 20_000]
                cols = [[None] * len(part), [None] * len(part), *zip(*part, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                data = codec.decompress(row["z"], row["n_bytes"], asbytes=True)
                for p in row["places"]:
                    place = p["place"]
                    left = data[max(0, place - least + anchor) : place][::-1]
                    entry = ((p["hash"] % 2**64).to_bytes(8, "big") + data[place : place + least], left)
                    if entry not in held:
                        held[entry] = []
                        size += 2 * least
                    held[entry].append((row["k_id"], row["k_text"], place))
                    size += 100
                if size > 64 << 20:
                    yield from send()
                    held, size = {}, 0
        if held:
            yield from send()

    return rows.select("k_id", "k_text", "z", "n_bytes", "places").mapInArrow(run, schema)


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """k_id, k_text, start, stop: stretches that a repeat covers, from the runs of each destination.

    A mark's run and number stand in place of the text, with start and stop relative to its places.
    """

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec("zstd")
        coded = [pickle.loads(codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)) for b in group["blob"]]
        found: list[tuple[int, int, int, int]] = []
        marks: list[tuple[int, int, int, int]] = []
        keys, shared, lefts, places = [], [], [], []

        def close():
            counts = [2 if any(x[2] < 0 for x in p) else len(p) for p in places]
            for (back, on), own in zip(covered(keys, shared, lefts, counts, least, 8), places, strict=True):
                if on:
                    found.extend((k_id, k_text, place - back, place + on) for k_id, k_text, place in own if place >= 0)
                    marks.extend((run, number, -back, on) for run, number, place in own if place < 0)

        for same, key, left, own in merge(coded):
            if keys and same < 8:
                close()
                keys, shared, lefts, places = [], [], [], []
            if keys and same == len(key) == len(keys[-1]) and left == lefts[-1]:
                places[-1] = places[-1] + own
                continue
            keys.append(key)
            shared.append(same)
            lefts.append(left)
            places.append(own)
        if keys:
            close()
        rows = pd.DataFrame(found + marks, columns=["k_id", "k_text", "start", "stop"], dtype="int64")
        return rows.assign(mark=np.arange(len(rows)) >= len(found))

    return runs.groupBy("dest").applyInPandas(combine, "k_id long, k_text long, start long, stop long, mark boolean")


def _sorted_out(rows: DataFrame, places: DataFrame, total: int, least: int, anchor: int) -> DataFrame:
    """k_id, k_text, start, stop that the suffixes at these places cover."""
    runs = common.staged(_runs(_packed(rows).join(places, ["k_id", "k_text"]), max(1, -(-total // PER_DESTINATION)), least, anchor), "runs")
    merged = common.staged(_merged(runs.filter(F.col("dest").isNotNull()).select("dest", "blob"), least), "merged")
    beside = runs.filter(F.col("run").isNotNull()).select("run", "number", "k_id", "k_text", "place")
    marks = merged.filter("mark").select(F.col("k_id").alias("run"), F.col("k_text").alias("number"), "start", "stop")
    many = beside.join(marks, ["run", "number"]).select("k_id", "k_text", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))
    return merged.filter("not mark").drop("mark").unionByName(many)


def stretches(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, crowd: int = CROWD, members: int = MEMBERS, bits: int = 64) -> DataFrame:
    """k_id, k_text, start, stop of covered bytes; they may overlap. ``bits``: of the hashes that filter and deal out."""
    rows = common.keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    anchors = common.staged(_places_table(rows.select("k_id", "k_text", "raw"), least, anchor, bits), "anchors")
    places = common.staged(_by_text(_marked(anchors, crowd, members)), "places")  # a document's own anchors: no more than its text
    total, crowds = places.agg(F.sum(F.size("places")), F.max(F.size("crowd"))).first()
    found = _sorted_out(rows, places.filter(F.size("places") > 0).select("k_id", "k_text", "places"), total or 0, least, anchor)
    if not crowds:
        return found
    crowded = places.filter(F.size("crowd") > 0).select("k_id", "k_text", "crowd")
    windows = common.staged(_windows(_packed(rows).join(crowded, ["k_id", "k_text"]), least, anchor, bits), "windows")
    alike = common.staged(_by_text(_marked(windows, 2**62, 2**62)).select("k_id", "k_text", "places"), "alike")
    total = alike.agg(F.sum(F.size("places"))).first()[0] or 0
    return found.unionByName(_sorted_out(rows, alike, total, least, least))


def deduplicated(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, crowd: int = CROWD, members: int = MEMBERS, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    found = stretches(docs, least, anchor, crowd, members, bits).distinct().groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "stop")).alias("cut"))
    found = common.staged(found, "stretches")
    rows = common.keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("doc_id", "z", "n_bytes", "cut")), strict=True):
                doc, z, n, cut = (x.as_py() for x in row)
                data = codec.decompress(z, n, asbytes=True)
                kept, at, spans, open_ = [], 0, 0, -1
                for start, stop in sorted((c["start"], c["stop"]) for c in cut or []):
                    if start > open_:  # touching stretches are one
                        spans += 1
                        kept.append(data[at:start])
                    at = open_ = max(open_, stop)
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc, n, n - len(left), spans, left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.binary()], strict=True)] if out else [pa.nulls(0, t) for t in [*[pa.int64()] * 4, pa.binary()]], names)

    joined = _packed(rows).join(found, ["k_id", "k_text"], "left")
    return joined.select("doc_id", "z", "n_bytes", "cut").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
