"""Zero-phase band-pass of whole recordings as a distributed linear-recurrence scan.

A recursive filter is a state that every sample moves by a linear map, so a stretch of n samples takes the
state s to ``A^n s + b``, where b is what the stretch alone gives.  Such maps compose, and the state at the
start of any stretch is a prefix of the composition:

1. each block of chunks gives its (n, b), by matrix products over its samples;
2. blocks are composed in groups of ``fan``, groups over the recording, and the states travel back down
   (a two-level scan over short rows, no samples);
3. each block filters its own samples from its start state.

Backward filtering is the same scan from the other end, over the forward result.  No samples are copied to
neighbours, whatever the chunk length, and no recording is in one task; samples are shuffled once.

The filter is a Butterworth band-pass, applied forward and backward.  A recording is extended at both ends by
odd reflection of ``edge_samples`` samples, and each pass starts in the steady state of its first sample; a
recording shorter than that is extended by what it has.  A sample that is not finite stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nightframe.operators.spectral import _listed, _stacks
from nightframe.schemas import FILTER_HIGH_HZ, FILTER_LOW_HZ, FILTER_ORDER

#: Chunks per block, and blocks per group of the scan.
SPAN, FAN = 64, 1024
#: Samples whose response is one matrix.
STRIDE = 64


def sections(fs: float, low: float = FILTER_LOW_HZ, high: float = FILTER_HIGH_HZ, order: int = FILTER_ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (numerator, denominator) of the digital Butterworth band-pass."""
    if high >= fs / 2:
        raise ValueError("high cutoff must be below the Nyquist frequency")
    if order % 2:
        raise ValueError("the order must be even, so that poles come in pairs")
    edges = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    root = np.sqrt((prototype * width / 2) ** 2 - centre**2)
    poles = np.concatenate((prototype * width / 2 + root, prototype * width / 2 - root))
    gain = (width**order * (2 * fs) ** order / np.prod(2 * fs - poles)).real ** (1 / order)
    digital = sorted((p for p in (2 * fs + poles) / (2 * fs - poles) if p.imag > 0), key=abs)
    return [(gain * np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in digital]


def edge_samples(count: int) -> int:
    """Samples of extension for so many sections: three times the taps of the whole filter."""
    return 3 * (2 * count + 1)


@dataclass
class StateSpace:
    """y = c s + d x, then s = a s + b x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    _cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> StateSpace:
        """Sections one after the other, each with the state that turns by its pole: little rounding near the unit circle."""
        n = 2 * len(parts)

        def step(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
            state = state.copy()
            for i, (num, den) in enumerate(parts):
                y = num[0] * x + state[2 * i]
                state[2 * i] = num[1] * x - den[1] * y + state[2 * i + 1]
                state[2 * i + 1] = num[2] * x - den[2] * y
                x = y
            return state, x

        moved = [step(unit, 0.0) for unit in np.eye(n)]
        a, c = np.column_stack([m[0] for m in moved]), np.array([m[1] for m in moved])
        b, d = step(np.zeros(n), 1.0)
        turn = np.zeros((n, n))
        for i in range(0, n, 2):
            values, vectors = np.linalg.eig(a[i : i + 2, i : i + 2])
            v = vectors[:, int(np.argmax(values.imag))]
            v = v / v[np.argmax(np.abs(v))]
            turn[i : i + 2, i : i + 2] = np.column_stack([v.real, v.imag])
        back = np.linalg.inv(turn)
        return cls(back @ a @ turn, back @ b, c @ turn, float(d))

    def steady(self) -> np.ndarray:
        """The state that a constant one leads to."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def power(self, n: int) -> np.ndarray:
        if n not in self._cache:
            self._cache[n] = np.linalg.matrix_power(self.a, n)
        return self._cache[n]

    def _matrices(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(output of the samples, output of the state, state of the samples) over ``size`` samples."""
        key = ("m", size)
        if key not in self._cache:
            powers = [np.eye(len(self.b))]
            for _ in range(size):
                powers.append(powers[-1] @ self.a)
            response = np.array([self.d, *(self.c @ powers[k] @ self.b for k in range(size - 1))])
            shift = np.arange(size)[:, None] - np.arange(size)
            toeplitz = np.where(shift >= 0, response[np.maximum(shift, 0)], 0.0)
            self._cache[key] = toeplitz, np.array([self.c @ p for p in powers[:size]]), np.array([powers[size - 1 - i] @ self.b for i in range(size)])
        return self._cache[key]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, state at the end) of every row of samples from its state."""
        out, state = np.empty_like(x), np.array(state, float)
        rows, n = x.shape
        whole = n - n % STRIDE
        if whole:
            toeplitz, seen, moved = self._matrices(STRIDE)
            cut = x[:, :whole].reshape(rows, -1, STRIDE)
            own, ahead, on = cut @ toeplitz.T, cut @ moved, self.power(STRIDE).T
            for k in range(cut.shape[1]):
                own[:, k] += state @ seen.T
                state = state @ on + ahead[:, k]
            out[:, :whole] = own.reshape(rows, whole)
        if n > whole:
            toeplitz, seen, moved = self._matrices(n - whole)
            out[:, whole:] = x[:, whole:] @ toeplitz.T + state @ seen.T
            state = state @ self.power(n - whole).T + x[:, whole:] @ moved
        return out, state


def _extended(near: np.ndarray, edge: int) -> np.ndarray:
    """The samples before ``near`` (the recording's first ones) by odd reflection."""
    n = min(edge, len(near) - 1)
    return 2 * near[0] - near[n:0:-1]


def _stage(source: DataFrame, keep: Sequence[str], out: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Maps rows to the kept columns and what ``work`` makes of the batch: a dict of Arrow arrays by the names in ``out``."""
    names = [f.strip().split(" ")[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[made[n] for n in names]], names=[*keep, *names])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], out]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


PART = "struct<place:bigint,n:bigint,b:array<double>,head:array<double>,tail:array<double>,first:array<double>>"


def start_states(ends: DataFrame, space: StateSpace, edge: int, fan: int = FAN) -> DataFrame:
    """_key, _place, _state, _ext: the state at the start of every place, by a scan of two levels.

    ``ends``: _key, _place, n, b, head, tail, first.  The recording's first state is ``first`` of its first
    place or, where that is null, follows from its first samples; ``_ext`` continues the recording behind its
    last place and is null elsewhere.  Head and tail are the outermost ``edge + 1`` samples.
    """
    group = F.floor(F.col("_place") / fan).alias("_group")
    part = F.struct(F.col("_place").alias("place"), "n", "b", "head", "tail", "first")
    grouped = ends.groupBy("_key", group).agg(F.array_sort(F.collect_list(part)).cast(f"array<{PART}>").alias("_parts"))

    def composed(parts: list[dict]) -> dict:
        n, b, head, tail = 0, np.zeros(len(space.b)), [], []
        for p in parts:
            n, b = n + p["n"], space.power(p["n"]) @ b + np.array(p["b"])
            head = head + p["head"][: edge + 1 - len(head)]
            tail = (tail + p["tail"])[-edge - 1 :]
        return {"n": n, "b": b.tolist(), "head": head, "tail": tail, "first": parts[0]["first"]}

    def up(batch: pa.RecordBatch) -> dict:
        made = [composed(parts) for parts in batch.column("_parts").to_pylist()]
        kinds = {"n": pa.int64(), **{c: pa.list_(pa.float64()) for c in ("b", "head", "tail", "first")}}
        return {c: pa.array([m[c] for m in made], t) for c, t in kinds.items()}

    sums = _stage(grouped, ["_key", "_group"], "n bigint, b array<double>, head array<double>, tail array<double>, first array<double>", up)
    part_of_group = F.struct(F.col("_group").alias("place"), "n", "b", "head", "tail", "first")
    recordings = sums.groupBy("_key").agg(F.array_sort(F.collect_list(part_of_group)).cast(f"array<{PART}>").alias("_parts"))

    def walked(parts: list[dict], state: np.ndarray, ext: list[float] | None) -> list[dict]:
        out = []
        for p in parts:
            out.append({"place": p["place"], "state": state.tolist(), "ext": None})
            state = space.power(p["n"]) @ state + np.array(p["b"])
        out[-1]["ext"] = ext
        return out

    start = pa.list_(pa.struct([("place", pa.int64()), ("state", pa.list_(pa.float64())), ("ext", pa.list_(pa.float64()))]))
    out = "_starts array<struct<place:bigint,state:array<double>,ext:array<double>>>"

    def top(batch: pa.RecordBatch) -> dict:
        made = []
        for parts in batch.column("_parts").to_pylist():
            whole = composed(parts)
            if whole["first"] is not None:
                made.append(walked(parts, np.array(whole["first"]), []))
                continue
            before = _extended(np.array(whole["head"]), edge) if whole["head"] else np.zeros(0)
            origin = before[:1] if len(before) else np.array(whole["head"] or [0.0])[:1]
            _, state = space.run(before[None], (space.steady() * origin)[None])
            behind = _extended(np.array(whole["tail"])[::-1], edge)[::-1] if whole["tail"] else np.zeros(0)
            made.append(walked(parts, state[0], behind.tolist()))
        return {"_starts": pa.array(made, start)}

    def down(batch: pa.RecordBatch) -> dict:
        rows = zip(batch.column("_parts").to_pylist(), batch.column("_from").to_pylist(), strict=True)
        return {"_starts": pa.array([walked(parts, np.array(f["state"]), f["ext"]) for parts, f in rows], start)}

    first = _stage(recordings, ["_key"], out, top).select("_key", F.explode("_starts").alias("_from")).withColumn("_group", F.col("_from.place"))
    found = _stage(grouped.join(first, ["_key", "_group"]), ["_key"], out, down).select("_key", F.inline("_starts"))
    return found.select("_key", F.col("place").alias("_place"), F.col("state").alias("_state"), F.col("ext").alias("_ext"))


def bandpass(chunks: DataFrame, keys: Sequence[str], chunk: str, fs: float, signal: str = "x", out: str = "filtered", span: int = SPAN, fan: int = FAN) -> DataFrame:
    """keys, chunk, signal and ``out``, the zero-phase band-pass of each recording's chunks in order of their number."""
    parts = sections(fs)
    space, edge = StateSpace.of(parts), edge_samples(len(parts))
    width = len(space.b)
    own = F.struct(F.col(chunk).cast("bigint").alias("chunk"), F.coalesce(F.col(signal), F.array().cast("array<double>")).alias("x"))
    blocks = chunks.groupBy(F.struct(*keys).alias("_key"), F.floor(F.col(chunk) / span).cast("bigint").alias("_place")).agg(F.array_sort(F.collect_list(own)).alias("_own"))
    blocks = blocks.withColumn("_flat", F.flatten(F.transform("_own", lambda p: p["x"])))
    lists, doubles = pa.list_(pa.float64()), "array<double>"

    def ends(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {c: [None] * batch.num_rows for c in ("n", "b", "head", "tail")}
        for rows, x in _stacks(batch.column("_flat")):
            if not np.isfinite(x).all():
                raise ValueError("signal is not finite")
            _, state = space.run(x, np.zeros((len(x), width)))
            for at, row, b in zip(rows, x, state, strict=True):
                made["n"][at], made["b"][at], made["head"][at], made["tail"][at] = len(row), b, row[: edge + 1], row[-edge - 1 :]
        return {"n": pa.array(made["n"], pa.int64()), **{c: pa.array(made[c], lists) for c in ("b", "head", "tail")}, "first": pa.nulls(batch.num_rows, lists)}

    schema = f"n bigint, b {doubles}, head {doubles}, tail {doubles}, first {doubles}"
    states = start_states(_stage(blocks.drop("_own"), ["_key", "_place"], schema, ends), space, edge, fan)
    forward = blocks.join(states, ["_key", "_place"])

    def back_ends(batch: pa.RecordBatch) -> dict:
        n, bs, firsts = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
        state, ext = _matrix(batch.column("_state"), width), batch.column("_ext").to_pylist()
        for rows, x in _stacks(batch.column("_flat")):
            y, after = space.run(x, state[rows])
            _, b = space.run(y[:, ::-1], np.zeros((len(x), width)))
            for i, at in enumerate(rows):
                n[at], bs[at] = x.shape[1], b[i]
                if ext[at] is not None:  # behind the last sample: forward over the extension, then back over it
                    beyond, _ = space.run(np.array(ext[at], float)[None], after[i][None])
                    origin = beyond[0, -1:] if beyond.size else y[i, -1:] if y[i].size else np.zeros(1)
                    firsts[at] = space.run(beyond[:, ::-1], (space.steady() * origin)[None])[1][0]
        none = pa.array([[]] * batch.num_rows, lists)
        return {"n": pa.array(n, pa.int64()), "b": pa.array(bs, lists), "head": none, "tail": none, "first": pa.array(firsts, lists)}

    turned = forward.drop("_own").withColumn("_back", -F.col("_place"))
    backward = _stage(turned, ["_key", "_back"], schema, back_ends).withColumnRenamed("_back", "_place")
    back_states = start_states(backward, space, edge, fan).select("_key", (-F.col("_place")).alias("_place"), F.col("_state").alias("_from"))

    def both(batch: pa.RecordBatch) -> dict:
        made: list = [None] * batch.num_rows
        state, behind = _matrix(batch.column("_state"), width), _matrix(batch.column("_from"), width)
        for rows, x in _stacks(batch.column("_flat")):
            y, _ = space.run(x, state[rows])
            z, _ = space.run(np.ascontiguousarray(y[:, ::-1]), behind[rows])
            for at, row in zip(rows, z[:, ::-1], strict=True):
                made[at] = row
        return {"_filtered": _listed(made)}

    done = _stage(forward.join(back_states, ["_key", "_place"]), ["_key", "_own"], f"_filtered {doubles}", both)
    rows = done.select("_key", "_filtered", "_own", F.posexplode("_own").alias("_at", "_chunk"))
    before = F.aggregate(F.slice("_own", F.lit(1), F.col("_at")), F.lit(0), lambda acc, p: acc + F.size(p["x"]))
    return rows.select(
        *[F.col("_key").getField(k).alias(k) for k in keys], F.col("_chunk.chunk").alias(chunk), F.col("_chunk.x").alias(signal),
        F.slice("_filtered", before + 1, F.size("_chunk.x")).alias(out),
    )


def plain(x: np.ndarray, fs: float) -> np.ndarray:
    """The same filter over one whole recording, sample by sample; for checks."""
    parts = sections(fs)
    space, edge = StateSpace.of(parts), min(edge_samples(len(parts)), len(x) - 1)
    padded = np.concatenate((_extended(x, edge), x, _extended(x[::-1], edge)[::-1]))
    for _ in range(2):
        state, y = space.steady() * padded[0], np.empty(len(padded))
        for i, v in enumerate(padded):
            y[i] = space.c @ state + space.d * v
            state = space.a @ state + space.b * v
        padded = y[::-1]
    return padded[edge : len(padded) - edge]


__all__ = ["bandpass", "plain", "sections", "start_states", "StateSpace"]
