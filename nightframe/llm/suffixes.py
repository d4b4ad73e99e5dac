"""Sorted suffix runs: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: A suffix: its bytes (group first), what stands before it reversed, and where it occurs.
Entry = tuple[bytes, bytes, list]


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    step = 16
    while start < n:
        stop = min(n, start + step)
        if a[start:stop] != b[start:stop]:
            x = int.from_bytes(a[start:stop], "little") ^ int.from_bytes(b[start:stop], "little")
            return start + ((x & -x).bit_length() - 1) // 8
        start, step = stop, step * 2
    return n


def front_code(entries: Iterable[Entry]) -> list[tuple[int, bytes, bytes, list]]:
    """Sorted entries as (prefix shared with the last one, the rest, left context, places); equal ones become one."""
    out: list[tuple[int, bytes, bytes, list]] = []
    last, left = b"", None
    for key, before, places in entries:
        same = common_prefix(last, key)
        if out and same == len(key) == len(last) and before == left:
            out[-1][3].extend(places)
            continue
        out.append((same, key[same:], before, list(places)))
        last, left = key, before
    return out


class _Run:
    """One run being read: its key, and the prefix that the key shares with the last merged one."""

    __slots__ = ("items", "key", "shared", "entry")

    def __init__(self, coded: Iterable[tuple[int, bytes, bytes, list]]):
        self.items, self.key, self.shared, self.entry = iter(coded), b"", 0, None
        self.step()

    def step(self) -> None:
        item = next(self.items, None)
        if item is None:
            self.key = self.entry = None
            return
        # the last key of this run is the one merged last, so the stored prefix holds for that too
        self.shared, rest, before, places = item
        self.key = self.key[: self.shared] + rest
        self.entry = (before, places)


def merge(runs: list[Iterable[tuple[int, bytes, bytes, list]]]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """(prefix shared with the last, key, left context, places) in order over all front-coded runs.

    A run with the longer known prefix in common with the last key comes first, without looking at
    bytes; equal prefixes are compared from there on, and the loser keeps what was found.
    """
    heads = [_Run(r) for r in runs]
    size = 1 << max(0, (len(heads) - 1).bit_length())
    heads += [_Run(()) for _ in range(size - len(heads))]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = heads[a], heads[b]
        if x.key is None or y.key is None:
            return (b, a) if x.key is None else (a, b)
        if x.shared != y.shared:
            return (a, b) if x.shared > y.shared else (b, a)
        n = common_prefix(x.key, y.key, x.shared)
        if n == len(x.key) == len(y.key):
            first = x.entry[0] <= y.entry[0]
        else:
            first = n == len(x.key) or (n < len(y.key) and x.key[n] < y.key[n])
        (y if first else x).shared = n
        return (a, b) if first else (b, a)

    losers = [0] * size

    def start(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = play(start(2 * node), start(2 * node + 1))
        return won

    winner = start(1)
    while heads[winner].key is not None:
        head = heads[winner]
        yield head.shared, head.key, *head.entry
        head.step()
        node, won = (winner + size) // 2, winner
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2
        winner = won


def covered(keys: list[bytes], shared: list[int], lefts: list[bytes], counts: list[int], least: int, skip: int) -> list[tuple[int, int]]:
    """For each suffix of one group (back, on): bytes before and after its place that a repeat covers.

    ``keys`` are sorted and start with ``skip`` bytes that aren't text; ``shared`` are their prefixes in
    common with the one before. A repeat needs a partner with left + right >= ``least`` bytes in common.
    Nodes of the prefix tree are visited from the root; in each, left neighbours in the order of the
    left contexts give the longest left part that right parts of the node's depth go with.
    """
    back, on = [0] * len(keys), [0] * len(keys)

    def take(i: int, left: int, right: int) -> None:
        if left + right >= least:
            back[i], on[i] = max(back[i], left), max(on[i], right)

    for i, n in enumerate(counts):
        if n > 1:
            take(i, len(lefts[i]), len(keys[i]) - skip)
    if len(keys) < 2:
        return list(zip(back, on, strict=True))
    by_left = sorted(range(len(keys)), key=lefts.__getitem__)
    todo = [(0, len(keys), by_left)]
    while todo:
        a, b, order = todo.pop()
        depth = min(shared[a + 1 : b])
        right = depth - skip
        near = [0, *(common_prefix(lefts[x], lefts[y]) for x, y in zip(order, order[1:], strict=False)), 0]
        for at, i in enumerate(order):
            take(i, max(near[at], near[at + 1]), right)
        cuts = [a, *(k for k in range(a + 1, b) if shared[k] == depth), b]
        part = np.searchsorted(cuts, order, side="right") - 1
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if y - x > 1:
                todo.append((x, y, [order[j] for j in np.flatnonzero(part == k)]))
    return list(zip(back, on, strict=True))
