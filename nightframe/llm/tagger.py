"""Character-level bidirectional LSTM with CRF transitions in numpy: training, decoding, reconciling windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
WINDOW, STRIDE = 128, 64  # what is at most WINDOW - STRIDE long lies whole in some window
HIDDEN = 16
_CODES = np.full(128, 1, np.int64)
_CODES[32:127] = np.arange(2, 97)
_CODES[48:58] = _CODES[48]  # digits alike
_CODES[65:91] = _CODES[65]  # capitals alike
_OTHER = 97
VOCABULARY = 98


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], _OTHER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "ef": rng.normal(0, 0.3, (VOCABULARY, 4 * h)),
            "eb": rng.normal(0, 0.3, (VOCABULARY, 4 * h)),
            "uf": rng.normal(0, 0.25, (h, 4 * h)),
            "ub": rng.normal(0, 0.25, (h, 4 * h)),
            "w": rng.normal(0, 0.3, (2 * h, LABELS)),
            "b": np.zeros(LABELS),
            "a": np.zeros((LABELS, LABELS)),
        }
        self.p["ef"][:, h : 2 * h] += 1
        self.p["eb"][:, h : 2 * h] += 1

    def _lstm(self, x: np.ndarray, e: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x (steps, rows) -> states (steps, rows, HIDDEN), and what the way back needs."""
        steps, rows = x.shape
        h = np.zeros((steps + 1, rows, HIDDEN))
        c = np.zeros((steps + 1, rows, HIDDEN))
        gates = np.empty((steps, rows, 4 * HIDDEN))
        cells = np.empty((steps, rows, HIDDEN))
        for t in range(steps):
            z = e[x[t]] + h[t] @ u
            gates[t, :, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
            gates[t, :, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = np.split(gates[t], 4, axis=1)
            c[t + 1] = f * c[t] + i * g
            cells[t] = np.tanh(c[t + 1])
            h[t + 1] = o * cells[t]
        return h, (x, c, gates, cells)

    def _lstm_back(self, h: np.ndarray, kept: tuple, u: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, c, gates, cells = kept
        du, all_dz = np.zeros_like(u), np.empty_like(gates)
        dh, dc = np.zeros_like(h[0]), np.zeros_like(h[0])
        for t in reversed(range(len(x))):
            i, f, o, g = np.split(gates[t], 4, axis=1)
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - cells[t] ** 2)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * cells[t] * o * (1 - o), dc * i * (1 - g**2)), axis=1)
            all_dz[t] = dz
            du += h[t].T @ dz
            dh, dc = dz @ u.T, dc * f
        seen = x.reshape(1, -1) == np.arange(VOCABULARY)[:, None]
        return seen.astype(all_dz.dtype) @ all_dz.reshape(-1, 4 * HIDDEN), du

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x (rows, steps) -> label scores (steps, rows, LABELS)."""
        p, s = self.p, x.T
        hf, kf = self._lstm(s, p["ef"], p["uf"])
        hb, kb = self._lstm(s[::-1], p["eb"], p["ub"])
        both = np.concatenate((hf[1:], hb[1:][::-1]), axis=2)
        out = both @ p["w"] + p["b"]
        return (out, both, hf, kf, hb, kb) if keep else out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the label rows under the CRF, and its gradients."""
        p, y = self.p, y.T
        em, both, hf, kf, hb, kb = self.emissions(x, keep=True)
        steps, rows, _ = em.shape
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            alpha[t] = em[t] + _logsum(alpha[t - 1][:, :, None] + p["a"], 1)
        for t in reversed(range(steps - 1)):
            beta[t] = _logsum(p["a"] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        at = np.arange(rows)
        gold = sum(em[t, at, y[t]] for t in range(steps)) + sum(p["a"][y[t - 1], y[t]] for t in range(1, steps))
        d_em = np.exp(alpha + beta - z[:, None])
        da = np.zeros_like(p["a"])
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + p["a"] + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(da, (y[t - 1], y[t]), -1)
        for t in range(steps):
            d_em[t, at, y[t]] -= 1
        d_em, da = d_em / rows, da / rows
        d_both = d_em @ p["w"].T
        ef, uf = self._lstm_back(hf, kf, p["uf"], d_both[:, :, :HIDDEN])
        eb, ub = self._lstm_back(hb, kb, p["ub"], d_both[:, :, HIDDEN:][::-1])
        w = np.einsum("trh,trl->hl", both, d_em)
        return float((z - gold).mean()), {"ef": ef, "uf": uf, "eb": eb, "ub": ub, "w": w, "b": d_em.sum(axis=(0, 1)), "a": da}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Tagger:
        """Adam over shuffled batches; the same rows give the same model."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(x))
            for at in range(0, len(x) if step < steps else 0, batch):
                own = order[at : at + batch]
                _, grads = self.loss(x[own], y[own])
                step += 1
                lr = rate * max(0.1, 1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels (rows, steps), and the label's score above none at each step."""
        em = self.emissions(x)
        steps, rows, _ = em.shape
        best, back = em[0], np.zeros((steps, rows, LABELS), np.int64)
        for t in range(1, steps):
            scores = best[:, :, None] + self.p["a"]
            back[t] = scores.argmax(axis=1)
            best = scores.max(axis=1) + em[t]
        labels = np.empty((steps, rows), np.int64)
        labels[-1] = best.argmax(axis=1)
        at = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            labels[t - 1] = back[t, at, labels[t]]
        over = np.take_along_axis(em, labels[:, :, None], 2)[:, :, 0] - em[:, :, 0]
        return labels.T, over.T


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the text."""
    return list(range(0, max(1, len(text) - STRIDE), STRIDE)) if text else []


def labelled(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, start, stop in spans:
        k = KINDS.index(kind)
        y[start:stop] = 2 + 2 * k
        y[start] = 1 + 2 * k
    return y


def spans_of(labels: np.ndarray, over: np.ndarray, at: int, length: int) -> list[tuple[int, int, str, float]]:
    """(start, stop, kind, weight) of the spans in one window; one cut by the window's end is left to the next window."""
    out, stop, size = [], 0, min(len(labels), length - at)
    for i in range(size):
        if i < stop or not labels[i]:
            continue
        k = (int(labels[i]) - 1) // 2
        stop = i + 1
        while stop < size and labels[stop] == 2 + 2 * k:
            stop += 1
        if (i > 0 or at == 0) and (stop < size or at + size == length):
            out.append((at + i, at + stop, KINDS[k], float(over[i:stop].sum())))
    return out


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int]]:
    """The spans of all windows that don't overlap and weigh most together (weighted interval scheduling)."""
    best: dict[tuple[int, int, str], float] = {}
    for start, stop, kind, weight in found:
        if weight > 0:
            best[start, stop, kind] = max(weight, best.get((start, stop, kind), 0))
    spans = sorted(((b, a, k, w) for (a, b, k), w in best.items()))
    ends = [s[0] for s in spans]
    total, took = [0.0], []
    for i, (_, a, _, w) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        took.append((total[before] + w > total[i], before))
        total.append(max(total[i], total[before] + w))
    out, i = [], len(spans)
    while i:
        use, before = took[i - 1]
        if use:
            b, a, k, _ = spans[i - 1]
            out.append((k, a, b))
            i = before
        else:
            i -= 1
    return out[::-1]
