"""Character tagger: a bidirectional LSTM whose tag scores feed a linear-chain CRF, in numpy.

Rows of characters are tagged with O, B-kind and I-kind.  Training minimises the CRF's negative log-likelihood by Adam with
gradients through time; decoding is Viterbi's.  All arrays are time-major and padded; padding keeps both directions' states at
zero, so that a row's scores don't depend on its neighbours in a batch.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Characters by number: 0 is padding, then the printable ASCII ones, white space, other letters and digits, anything else.
_OTHER_SPACE, _OTHER_WORD, _OTHER, N_CHARS = 96, 97, 98, 99
_LOW = -1e4


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = codes - 31
    if (odd := np.flatnonzero((codes < 32) | (codes > 126))).size:
        out[odd] = [_OTHER_SPACE if text[i].isspace() else _OTHER_WORD if text[i].isalnum() else _OTHER for i in odd.tolist()]
    return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows side by side: (longest, rows), and which places hold something."""
    ids = np.zeros((max(map(len, rows)), len(rows)), np.int64)
    for k, r in enumerate(rows):
        ids[: len(r), k] = r
    return ids, np.arange(len(ids))[:, None] < np.array([len(r) for r in rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """``p``: emb; wf, uf, bf and wb, ub, bb of the two directions; wo, bo of the tags; trans, first of the chain."""

    kinds: tuple[str, ...]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, kinds: tuple[str, ...], *, embed: int = 16, hidden: int = 24, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        t = 2 * len(kinds) + 1
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": draw(N_CHARS, embed) * 3, "wo": draw(2 * hidden, t), "bo": np.zeros(t, np.float32), "trans": np.zeros((t, t)), "first": np.zeros(t)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            p |= {f"w{d}": draw(embed, 4 * hidden), f"u{d}": draw(hidden, 4 * hidden), f"b{d}": bias}
        return cls(kinds, p)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, kinds: tuple[str, ...], data: bytes) -> Tagger:
        with np.load(io.BytesIO(data)) as z:
            return cls(kinds, {k: z[k] for k in z.files})

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions and first scores; I-kind follows B-kind or I-kind only."""
        t = 2 * len(self.kinds) + 1
        trans, first = self.p["trans"].astype(float), self.p["first"].astype(float)
        for k in range(len(self.kinds)):
            ok = np.zeros(t, bool)
            ok[[1 + 2 * k, 2 + 2 * k]] = True
            trans[~ok, 2 + 2 * k] = _LOW
            first[2 + 2 * k] = _LOW
        return trans, first

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        u, n = self.p[f"u{d}"], self.p[f"u{d}"].shape[0]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, past = np.empty((*x.shape[:2], n), np.float32), []
        for t in steps:
            a = z[t] + h @ u
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            th = np.tanh(new)
            if keep:
                past.append((t, h, c, i, f, o, g, th, m))
            h, c = o * th * m, new
            out[t] = h
        return out, past

    def _direction_back(self, x: np.ndarray, past: list, grad_out: np.ndarray, d: str, grads: dict) -> np.ndarray:
        u = self.p[f"u{d}"]
        gz = np.zeros((*x.shape[:2], u.shape[1]), np.float32)
        gh = gc = np.zeros((x.shape[1], u.shape[0]), np.float32)
        gu = np.zeros_like(u)
        for t, h, c, i, f, o, g, th, m in reversed(past):
            gh = (gh + grad_out[t]) * m
            gc = (gc + gh * o * (1 - th * th)) * m
            a = np.concatenate([gc * g * i * (1 - i), gc * c * f * (1 - f), gh * th * o * (1 - o), gc * i * (1 - g * g)], axis=1)
            gz[t] = a
            gu += h.T @ a
            gh, gc = a @ u.T, gc * f
        flat = gz.reshape(-1, gz.shape[2])
        grads[f"u{d}"], grads[f"b{d}"], grads[f"w{d}"] = gu, flat.sum(0), x.reshape(-1, x.shape[2]).T @ flat
        return gz @ self.p[f"w{d}"].T

    def scores(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, rows, tags)"""
        x = self.p["emb"][ids]
        both = np.concatenate([self._direction(x, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["wo"] + self.p["bo"]

    def loss(self, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a row and its gradients."""
        x = self.p["emb"][ids]
        runs = {d: self._direction(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        em = (both @ self.p["wo"] + self.p["bo"]).astype(float)
        trans, first = self.chain()
        rows, n = np.arange(ids.shape[1]), ids.shape[1]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = first + em[0]
        for t in range(1, len(em)):
            alpha[t] = np.where(mask[t][:, None], _lse(alpha[t - 1][:, :, None] + trans, 1) + em[t], alpha[t - 1])
        for t in range(len(em) - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None], _lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        total = _lse(alpha[-1], 1)
        hot = np.zeros_like(em)
        np.put_along_axis(hot, tags[:, :, None], 1.0, 2)
        hot *= mask[:, :, None]
        ge = np.exp(alpha + beta - total[:, None]) * mask[:, :, None]
        grads = {"first": (ge[0] - hot[0]).sum(0) / n}
        both_in = mask[1:]
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - total[:, None, None]) * both_in[:, :, None, None]
        counts = np.zeros_like(trans)
        np.add.at(counts, (tags[:-1][both_in], tags[1:][both_in]), 1.0)
        grads["trans"] = (pair.sum((0, 1)) - counts) / n
        path = (em * hot).sum() + first[tags[0]].sum() + trans[tags[:-1][both_in], tags[1:][both_in]].sum()
        ge = ((ge - hot) / n).astype(np.float32)
        flat = ge.reshape(-1, ge.shape[2])
        grads["bo"], grads["wo"] = flat.sum(0), both.reshape(-1, both.shape[2]).T @ flat
        gb = ge @ self.p["wo"].T
        half = gb.shape[2] // 2
        gx = self._direction_back(x, runs["f"][1], gb[:, :, :half], "f", grads) + self._direction_back(x, runs["b"][1], gb[:, :, half:], "b", grads)
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], ids.ravel(), gx.reshape(-1, gx.shape[2]))
        return float(total.sum() - path) / n, grads

    def best(self, scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Viterbi tags of the rows that lie one after another in ``scores`` (places, tags), with offsets ``ends``."""
        trans, first = self.chain()
        out = np.zeros(len(scores), np.int64)
        lengths = np.diff(ends)
        rows = np.argsort(-lengths, kind="stable")
        rows = rows[lengths[rows] > 0]
        lo = 0
        while lo < len(rows):
            some = rows[lo : lo + max(1, min(512, (1 << 21) // int(lengths[rows[lo]])))]
            lo += len(some)
            start, k = ends[some], lengths[some]
            at = first + scores[start]
            back = np.zeros((int(k[0]), len(some), len(first)), np.int8)
            for t in range(1, int(k[0])):
                live = int(np.searchsorted(-k, -t, side="left"))  # rows longer than t come first
                step = at[:live, :, None] + trans
                back[t, :live] = step.argmax(1)
                at[:live] = step.max(1) + scores[start[:live] + t]
            tag = at.argmax(1)
            for t in range(int(k[0]) - 1, -1, -1):
                live = int(np.searchsorted(-k, -t, side="left"))
                out[start[:live] + t] = tag[:live]
                tag[:live] = back[t, np.arange(live), tag[:live]]
        return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the spans that a row's tags spell."""
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and not (t and t % 2 == 0 and t // 2 - 1 == kind):
            out.append((kind, start, i))
            start = -1
        if t % 2:
            start, kind = i, t // 2
    return out


def fit(kinds: tuple[str, ...], rows: list[tuple[str, list[tuple[int, int, int]]]], *, rounds: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Tagger:
    """A tagger from texts with labelled spans (kind's number, start, end).  Rows of like length share a batch."""
    model = Tagger.fresh(kinds, seed=seed)
    rng = np.random.default_rng(seed)
    data = []
    for text, spans in rows:
        tags = np.zeros(len(text), np.int64)
        for k, s, e in spans:
            tags[s:e] = 2 + 2 * k
            tags[s] = 1 + 2 * k
        if text:
            data.append((char_ids(text), tags))
    data.sort(key=lambda r: len(r[0]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    m, v = ({k: np.zeros_like(x, float) for k, x in model.p.items()} for _ in range(2))
    step, steps = 0, rounds * len(groups)
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            ids, mask = padded([r[0] for r in groups[g]])
            tags, _ = padded([r[1] for r in groups[g]])
            _, grads = model.loss(ids, mask, tags)
            norm = np.sqrt(sum(float((x.astype(float) ** 2).sum()) for x in grads.values()))
            step += 1
            lr = rate * (1 - 0.9 * step / steps)
            for k, x in grads.items():
                x = x.astype(float) * min(1.0, 5.0 / max(norm, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                model.p[k] = (model.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(model.p[k].dtype)
    return model
