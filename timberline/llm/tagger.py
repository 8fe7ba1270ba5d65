"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Gates and cells are squashed by z / (1 + |z|), which numpy computes several times
faster than a hyperbolic tangent. ``python -m timberline.llm.tagger`` trains it from the labelled spans that
``spans`` makes and writes the weights beside this module; ``trained`` reads them.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from timberline.llm.spans import KINDS, Maker

O_TAG, TAGS = 0, 1 + 2 * len(KINDS)  # outside; for each kind its first and its further characters
SYMBOLS, PAD = 131, 130
WEIGHTS = os.path.join(os.path.dirname(__file__), "tagger.npz")
TRAIN_SIZE = 192


def codes(text: str) -> np.ndarray:
    """Symbol of each character: ASCII as it is, other letters, other characters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, raw, np.where((raw >= 0xC0) & (raw < 0x250), 128, 129)).astype(np.uint8)


def squash(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


class Tagger:
    """Embedding, LSTMs in both directions, emissions, CRF transitions."""

    def __init__(self, seed: int = 11, embed: int = 12, hidden: int = 10, weights: dict | None = None):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        if weights is None:
            weights = {"emb": w(SYMBOLS, embed) * 4, "out": w(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
            for d in "fb":
                bias = np.zeros(4 * hidden, np.float32)
                bias[hidden : 2 * hidden] = 1.0
                weights |= {f"x{d}": w(embed, 4 * hidden), f"h{d}": w(hidden, 4 * hidden), f"g{d}": bias}
        self.p, self.hidden = weights, weights["hf"].shape[0]

    # ------------------------------------------------------------ decoding

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags, (rows, steps, tags)."""
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        # a gate's row holds all windows, so that each step works on long stretches
        table = [np.ascontiguousarray((self.p["emb"] @ self.p[f"x{d}"] + self.p[f"g{d}"]).T) for d in "fb"]
        # gates are kept at twice their value, so states are too
        turn = [np.ascontiguousarray((self.p[f"h{d}"] * np.float32(0.5)).T) for d in "fb"]
        kind = turn[0].dtype
        c = np.zeros((2, h, n), kind)
        both = np.empty((steps, 2 * h, n), kind)
        z, size = np.empty((2, 4 * h, n), kind), np.empty((2, 4 * h, n), kind)
        room, start = np.empty((4 * h, n), kind), np.zeros((h, n), kind)
        order = np.ascontiguousarray(x.T).astype(np.intp)
        gates, new, out = z[:, : 3 * h], z[:, 3 * h :], size[:, :h]
        for t in range(steps):
            for k, at in enumerate((t, steps - 1 - t)):
                before = start if t == 0 else both[t - 1, :h] if k == 0 else both[at + 1, h:]
                np.dot(turn[k], before, out=z[k])
                np.take(table[k], order[at], axis=1, out=room, mode="clip")
                z[k] += room
            np.abs(z, out=size)
            size += 1
            z /= size
            gates += 1
            c *= gates[:, h : 2 * h]
            np.multiply(gates[:, :h], new, out=out)
            c += out
            c *= 0.5
            np.abs(c, out=out)
            out += 1
            np.divide(c, out, out=out)
            np.multiply(out[0], gates[0, 2 * h :], out=both[t, :h])
            np.multiply(out[1], gates[1, 2 * h :], out=both[steps - 1 - t, h:])
        em = np.matmul(np.ascontiguousarray((self.p["out"] * np.float32(0.5)).T), both)
        em += self.p["bias"][:, None]
        return np.ascontiguousarray(em.transpose(2, 0, 1))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (Viterbi) and their marginal probabilities (1 where all is outside), for rows of symbols."""
        em = self.emissions(x)
        tags, sure = np.zeros(x.shape, np.int8), np.ones(x.shape, np.float32)
        rows = self.open_rows(em)
        if len(rows):
            tags[rows] = self.best_path(em[rows])
        hit = np.flatnonzero(tags.any(axis=1))
        if len(hit):
            sure[hit] = self.certainty(em[hit], tags[hit])
        return tags, sure

    def open_rows(self, em: np.ndarray) -> np.ndarray:
        """Rows whose best path may leave the outside tag.

        A run off it gains at most the best of its tags, step by step, the best of
        their transitions, one way in, and one way out unless it lasts to the end.
        Where no run gains, all is outside; the greatest sum over runs that end at a
        step is the rise of the running sum above its least value before.
        """
        trans, first = self.p["trans"] - self.p["trans"][O_TAG, O_TAG], self.p["first"] - self.p["first"][O_TAG]
        others = [t for t in range(TAGS) if t != O_TAG]
        stay, out = float(trans[np.ix_(others, others)].max()), float(trans[others, O_TAG].max())
        into = max(float(trans[O_TAG, others].max()), float(first[others].max()))
        best = em[:, :, others[0]]
        for t in others[1:]:
            best = np.maximum(best, em[:, :, t])
        sums = np.cumsum(best - em[:, :, O_TAG] + np.float32(stay), axis=1, dtype=np.float64)
        low = np.minimum.accumulate(np.concatenate([np.zeros((len(sums), 1)), sums[:, :-1]], axis=1), axis=1)
        rise = sums - low
        return np.flatnonzero(np.maximum(rise[:, :-1].max(axis=1) + out, rise[:, -1]) + into - stay > -1e-3)

    def best_path(self, em: np.ndarray) -> np.ndarray:
        n, steps, _ = em.shape
        e = np.ascontiguousarray(em.transpose(1, 2, 0))
        score, all_ = np.empty_like(e), np.empty((TAGS, TAGS, n), e.dtype)
        score[0] = self.p["first"][:, None] + e[0]
        step = self.p["trans"][:, :, None]
        for t in range(1, steps):
            np.add(score[t - 1][:, None, :], step, out=all_)
            np.max(all_, axis=0, out=score[t])
            score[t] += e[t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = score[-1].argmax(axis=0)
        # which tag came before is asked along the path only
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = (score[t - 1] + self.p["trans"][:, tags[:, t]]).argmax(axis=0)
        return tags

    def certainty(self, em: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Marginal probability of given tags."""
        return np.take_along_axis(self.marginals(em), tags[:, :, None].astype(np.int64), 2)[:, :, 0]

    def marginals(self, em: np.ndarray) -> np.ndarray:
        """Probability of each tag at each step."""
        n, steps, _ = em.shape
        e = np.exp(em - em.max(axis=2, keepdims=True)).astype(np.float64)
        trans, first = np.exp(self.p["trans"].astype(np.float64)), np.exp(self.p["first"].astype(np.float64))
        forth, back = np.empty_like(e), np.ones_like(e)
        forth[:, 0] = first * e[:, 0]
        for t in range(1, steps):
            a = (forth[:, t - 1] / forth[:, t - 1].sum(axis=1, keepdims=True)) @ trans
            forth[:, t] = a * e[:, t]
        for t in range(steps - 2, -1, -1):
            b = (back[:, t + 1] * e[:, t + 1]) @ trans.T
            back[:, t] = b / b.sum(axis=1, keepdims=True)
        p = forth * back
        return p / p.sum(axis=2, keepdims=True)

    # ------------------------------------------------------------ training

    def _forward(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        pre = x @ self.p[f"x{d}"] + self.p[f"g{d}"]
        s, c, out = np.zeros((n, h), pre.dtype), np.zeros((n, h), pre.dtype), np.empty((n, steps, h), pre.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + s @ self.p[f"h{d}"]
            gates = 0.5 + 0.5 * squash(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], squash(z[:, 3 * h :])
            before = (s, c)
            c = f * c + i * g
            cell = squash(c)
            s = o * cell
            out[:, t] = s
            keep.append((t, i, f, o, g, cell, *before))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags and its gradient."""
        e = self.p["emb"][x]
        keep: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._forward(e, d, keep[d]) for d in "fb"], axis=2)
        em = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        n, steps, k = em.shape
        trans, first = self.p["trans"].astype(np.float64), self.p["first"].astype(np.float64)

        def logsum(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = first + em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = logsum(alpha[:, t - 1][:, :, None] + trans, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = logsum(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = logsum(alpha[:, -1], 1)
        rows = np.arange(n)
        gold = first[y[:, 0]] + em[rows[:, None], np.arange(steps), y].sum(axis=1) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        dem = np.exp(alpha + beta - z[:, None, None])
        dtrans = np.zeros((k, k))
        for t in range(1, steps):
            dtrans += np.exp(alpha[:, t - 1][:, :, None] + trans + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
        dem[rows[:, None], np.arange(steps), y] -= 1.0
        dem = (dem / n).astype(both.dtype)
        g = {"trans": (dtrans / n).astype(both.dtype), "first": dem[:, 0].sum(axis=0)}
        g["bias"] = dem.sum(axis=(0, 1))
        g["out"] = both.reshape(n * steps, -1).T @ dem.reshape(n * steps, -1)
        dboth = dem @ self.p["out"].T
        h, de = self.hidden, np.zeros_like(e)
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            dz_all = np.zeros((n, steps, 4 * h), both.dtype)
            gh, ds, dc = np.zeros_like(self.p[f"h{d}"]), np.zeros((n, h), both.dtype), np.zeros((n, h), both.dtype)
            flat_gate = lambda v: 0.5 * (1 - np.abs(2 * v - 1)) ** 2
            for t, i, f, o, gg, cell, s0, c0 in reversed(keep[d]):
                ds = ds + part[:, t]
                dc = dc + ds * o * (1 - np.abs(cell)) ** 2
                dz = np.concatenate([dc * gg * flat_gate(i), dc * c0 * flat_gate(f), ds * cell * flat_gate(o), dc * i * (1 - np.abs(gg)) ** 2], axis=1)
                dz_all[:, t] = dz
                gh += s0.T @ dz
                ds, dc = dz @ self.p[f"h{d}"].T, dc * f
            flat = dz_all.reshape(n * steps, -1)
            g[f"h{d}"], g[f"g{d}"] = gh, flat.sum(axis=0)
            g[f"x{d}"] = e.reshape(n * steps, -1).T @ flat
            de += dz_all @ self.p[f"x{d}"].T
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], x.ravel(), de.reshape(n * steps, -1))
        return float((z - gold).mean()), g

    def train(self, steps: int = 2200, rows: int = 56, seed: int = 5, rate: float = 0.02) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            x, y = batch(rng, rows)
            _, g = self.gradients(x, y)
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            now = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return self


def batch(rng: np.random.Generator, rows: int, size: int = TRAIN_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and their tags."""
    make = Maker(rng)
    x, y = np.zeros((rows, size), np.uint8), np.zeros((rows, size), np.int64)
    for r in range(rows):
        text, spans = make.text(size)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        shift = int(rng.integers(0, len(text) - size + 1))
        x[r], y[r] = codes(text)[shift : shift + size], tags[shift : shift + size]
        if rng.random() < 0.1:  # texts end
            end = int(rng.integers(10, size))
            x[r, end:], y[r, end:] = PAD, O_TAG
    return x, y


@functools.lru_cache(1)
def trained() -> Tagger:
    """The production tagger."""
    with np.load(WEIGHTS) as f:
        return Tagger(weights={k: f[k] for k in f.files})


if __name__ == "__main__":
    np.savez(WEIGHTS, **Tagger().train().p)
