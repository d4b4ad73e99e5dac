"""Personal data in texts: patterns, and spans that a character-level BiLSTM-CRF adds.

Patterns give the base: leftmost non-overlapping matches of each kind, those that fail its check
dropped. The model is trained in numpy on a bounded sample of documents (the ``SAMPLE`` with the
smallest hash of those that hold a digit or an at sign), labelled by the patterns; some phone numbers
lose their country sign, so that the model learns how they look without it. It labels overlapping
windows of every text; the spans of all windows are reconciled over the whole text, and those that are
plausible and touch no base span are added. A plausible span holds an at sign or digits, so windows
with neither cannot add one and are not labelled: leaving them out changes nothing.

A null text is empty and has no spans. Rows are independent, so repeated rows have equal results. With
no document to learn from, nothing is added. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm import common
from nightframe.llm.tagger import KINDS, STRIDE, WINDOW, Tagger, codes, labelled, reconcile, spans_of, windows

#: Documents that the model may learn from, and windows of them.
SAMPLE, TRAINING_WINDOWS = 600, 1200
Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]")
_NATIONAL = re.compile(r"\+[0-9]+ (?=\()")


def _emails(text: str) -> list[Span]:
    """From at sign to at sign, so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[Span]:
    """Four parts at a time of each run of dotted numbers."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append(("ip", at, stop))
            at = stop + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind as in KINDS, then by start; code points, end exclusive."""
    out = _emails(text)
    if not _TELLING.search(text):
        return out
    out += _ips(text)
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plausible(kind: str, text: str, start: int, stop: int) -> bool:
    """Whether a span that the model found can be of its kind; it has to stand free of letters and digits."""
    span = text[start:stop]
    if (start and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum()):
        return False
    digits = _digits(span)
    if kind == "email":
        name, at, host = span.partition("@")
        return bool(name and at and host) and not re.search(r"[\s@]", name + host)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not re.search(r"[^ ()+0-9-]", span) and bool(re.search(r"[0-9][ )-]", span)) and span.strip() == span
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^ 0-9-]", span)
    return len(_ips(span)) == 1 and _ips(span)[0] == ("ip", 0, len(span))


def training_rows(texts: list[str], most: int = TRAINING_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows around what has digits or at signs, with labels from the patterns."""
    xs, ys = [], []
    for n, text in enumerate(texts):
        if n % 3 == 0:
            spans = [s for s in base_spans(text) if s[0] == "phone"]
            for _, start, stop in reversed(spans):
                short = _NATIONAL.sub("", text[start:stop])
                text = text[:start] + "\x00" * (short != text[start:stop]) + short + text[stop:]
        spans = base_spans(text.replace("\x00", ""))
        marked, shift = [], 0
        for i, c in enumerate(text):
            if c == "\x00":
                end = re.compile(r"[ ()0-9-]*[0-9]").match(text, i + 1)
                if end:
                    marked.append(("phone", i - shift, end.end() - 1 - shift))
                shift += 1
        text = text.replace("\x00", "")
        x, y = codes(text), labelled(len(text), spans + marked)
        taken = -WINDOW
        for m in _TELLING.finditer(text):
            if m.start() < taken + WINDOW // 2:
                continue
            at = max(0, m.start() - 20 - (7 * m.start()) % 60)
            taken = at + 20
            own_x, own_y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            part = x[at : at + WINDOW]
            own_x[: len(part)], own_y[: len(part)] = part, y[at : at + WINDOW]
            xs.append(own_x)
            ys.append(own_y)
            if len(xs) == most:
                return np.array(xs), np.array(ys)
    return np.array(xs), np.array(ys)


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A model from a bounded sample of rows, or None where there is nothing to learn from."""
    telling = docs.filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # a threshold that about twice the sample is below, so that tasks send the driver no more than that together
    share = min(1.0, 2 * sample / max(1, telling.count()))
    below = min(2**63 - 1, int(-(2**63) + share * 2**64))
    texts = [r["text"] for r in telling.filter(F.col("h") <= F.lit(below)).orderBy("h", "text").limit(sample).collect()]
    x, y = training_rows(texts)
    return Tagger().fit(x, y) if len(x) else None


def model_spans(texts: list[str], tagger: Tagger, every: bool = False, rows: int = 256) -> list[list[Span]]:
    """The model's spans of each text, reconciled over its windows; every: label the windows that cannot add one too."""
    jobs = []
    for n, text in enumerate(texts):
        for at in windows(text):
            if every or _TELLING.search(text, at, at + WINDOW):
                jobs.append((n, at))
    found: list[list] = [[] for _ in texts]
    for start in range(0, len(jobs), rows):
        own = jobs[start : start + rows]
        x = np.zeros((len(own), WINDOW), np.int64)
        for i, (n, at) in enumerate(own):
            part = codes(texts[n][at : at + WINDOW])
            x[i, : len(part)] = part
        labels, over = tagger.decode(x)
        for i, (n, at) in enumerate(own):
            found[n] += [s for s in spans_of(labels[i], over[i], at, len(texts[n])) if s[1] - s[0] <= WINDOW - STRIDE and plausible(s[2], texts[n], s[0], s[1])]
    return [reconcile(f) for f in found]


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) for each text; both by kind, then start."""
    more = model_spans(texts, tagger) if tagger else [[] for _ in texts]
    out = []
    for text, added in zip(texts, more, strict=True):
        base = base_spans(text)
        extra = [s for s in added if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, base (joined spans), spans (all, joined), n_email, n_ip, n_card, n_phone (of the base), n_added."""
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            both = all_spans(texts, tagger)
            cols = [batch.column("doc_id"), pa.array([joined(b) for b, _ in both], pa.string()), pa.array([joined(a) for _, a in both], pa.string())]
            cols += [pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64()) for k in KINDS]
            cols.append(pa.array([len(a) - len(b) for b, a in both], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "base", "spans", *counts, "n_added"])

    schema = "doc_id long, base string, spans string, " + ", ".join(f"{c} long" for c in (*counts, "n_added"))
    return common.short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return found(docs, train(docs)).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
