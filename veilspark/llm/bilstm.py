"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Scores of ``tags`` for each of a window's character classes, and the transitions between tags."""

    def __init__(self, classes: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 11):
        r = np.random.default_rng(seed)

        def draw(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden, self.w = hidden, {"embed": draw(classes, embed) * np.float32(np.sqrt(classes) * 0.5), "out": draw(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "next": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.w |= {f"x{d}": draw(embed, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"b{d}": bias}

    def _lstm(self, x, d, keep):
        """Hidden states of one direction over x (time, batch, 4 hidden); what the gradient needs too if ``keep``."""
        h, n, t = self.hidden, x.shape[1], len(x)
        out, c, state, kept = np.empty((t, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[k] + state @ self.w[f"h{d}"]
            g = _sigmoid(z)
            i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], np.tanh(z[:, 3 * h :])
            if keep:
                kept.append((k, state, c, i, f, o, u))
            c = f * c + i * u
            state = o * np.tanh(c)
            out[k] = state
            if keep:
                kept[-1] += (c,)
        return out, kept

    def scores(self, windows: np.ndarray, keep: bool = False):
        """(time, batch, tags) of windows (batch, time) of character classes."""
        w = self.w
        e = w["embed"][windows.T]
        f, kf = self._lstm(e @ w["xf"] + w["bf"], "f", keep)
        b, kb = self._lstm(e @ w["xb"] + w["bb"], "b", keep)
        hs = np.concatenate([f, b], axis=2)
        out = hs @ w["out"] + w["out_b"]
        return (out, (e, hs, kf, kb)) if keep else out

    def gradient(self, windows: np.ndarray, tags: np.ndarray):
        """(loss per character, gradients) of the CRF likelihood of ``tags`` (batch, time)."""
        w, h = self.w, self.hidden
        s, (e, hs, kf, kb) = self.scores(windows, True)
        t, n, k = s.shape
        a, z = np.empty_like(s), np.empty_like(s)
        a[0], z[-1] = s[0], 0
        for i in range(1, t):
            a[i] = s[i] + _logsum(a[i - 1][:, :, None] + w["next"], 1)
        for i in range(t - 2, -1, -1):
            z[i] = _logsum(w["next"] + (s[i + 1] + z[i + 1])[:, None, :], 2)
        total = _logsum(a[-1], 1)
        y = tags.T
        rows, cols = np.arange(t)[:, None], np.arange(n)
        gold = s[rows, cols, y].sum(0) + w["next"][y[:-1], y[1:]].sum(0)
        ds = np.exp(a + z - total[None, :, None])
        pair = np.exp(a[:-1, :, :, None] + w["next"] + (s[1:] + z[1:])[:, :, None, :] - total[None, :, None, None])
        dnext = pair.sum((0, 1))
        np.subtract.at(dnext, (y[:-1].ravel(), y[1:].ravel()), 1)
        ds[rows, cols, y] -= 1
        scale = np.float32(1 / (n * t))
        ds, g = ds * scale, {"next": dnext * scale}
        g["out"], g["out_b"] = np.einsum("tnh,tnk->hk", hs, ds), ds.sum((0, 1))
        dh, de = ds @ w["out"].T, 0
        for d, kept, part in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
            dx, carry, dc = np.empty((t, n, 4 * h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            gh = np.zeros_like(w[f"h{d}"])
            for i, before, c0, gi, gf, go, gu, c1 in reversed(kept):
                up, th = part[i] + carry, np.tanh(c1)
                dc = dc + up * go * (1 - th * th)
                dz = np.concatenate([dc * gu * gi * (1 - gi), dc * c0 * gf * (1 - gf), up * th * go * (1 - go), dc * gi * (1 - gu * gu)], axis=1)
                dc, carry, dx[i] = dc * gf, dz @ w[f"h{d}"].T, dz
                gh += before.T @ dz
            g[f"h{d}"], g[f"b{d}"], g[f"x{d}"] = gh, dx.sum((0, 1)), np.einsum("tne,tnz->ez", e, dx)
            de = de + dx @ w[f"x{d}"].T
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], windows.T.ravel(), de.reshape(-1, de.shape[2]))
        return float((total - gold).sum() * scale), g

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int, rate: float = 0.03, batch: int = 32, seed: int = 12) -> list[float]:
        """Adam over shuffled batches, the rate falling to a tenth; the loss of each epoch."""
        r, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        steps = max(1, epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order, loss = r.permutation(len(windows)), []
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x, g = self.gradient(windows[some], tags[some])
                loss.append(x)
                step += 1
                norm = np.sqrt(sum(float((y * y).sum()) for y in g.values()))
                lr = rate * (1 - 0.9 * step / steps)
                for k, y in g.items():
                    y = y * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * y
                    v[k] = 0.999 * v[k] + 0.001 * y * y
                    self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(loss)))
        return losses

    def decode(self, s: np.ndarray) -> np.ndarray:
        """The best path of tags for scores (time, tags)."""
        back, best = np.empty(s.shape, np.int64), s[0]
        for i in range(1, len(s)):
            x = best[:, None] + self.w["next"]
            back[i] = x.argmax(0)
            best = x.max(0) + s[i]
        path = [int(best.argmax())]
        for i in range(len(s) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return np.array(path[::-1])

    def decode_all(self, many: list[np.ndarray], cells: int = 1 << 18) -> list[np.ndarray]:
        """``decode`` of each of ``many``, those of like length together, so many that a batch has about ``cells`` rows of scores."""
        order, out, at = sorted(range(len(many)), key=lambda k: len(many[k])), [None] * len(many), 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(many[order[stop]]) <= cells:
                stop += 1
            some = order[at:stop]
            n = np.array([len(many[k]) for k in some])
            s = np.zeros((n[-1], len(some), len(self.w["next"])), np.float32)
            for r, k in enumerate(some):
                s[: n[r], r] = many[k]
            first = np.searchsorted(n, np.arange(n[-1]), "right")  # the first that is longer than i
            back, best = np.zeros(s.shape, np.int8), s[0]
            for i in range(1, n[-1]):
                j = first[i]
                x = best[j:, :, None] + self.w["next"]
                back[i, j:] = x.argmax(1)
                best[j:] = x.max(1) + s[i, j:]
            path, tag = np.empty((len(some), n[-1]), np.int64), best.argmax(1)
            for i in range(n[-1] - 1, 0, -1):
                j = first[i]
                path[j:, i] = tag[j:]
                tag[j:] = back[i, np.arange(j, len(some)), tag[j:]]
            path[:, 0] = tag
            for r, k in enumerate(some):
                out[k] = path[r, : n[r]]
            at = stop
        return out

    def marginals(self, s: np.ndarray) -> np.ndarray:
        """Probabilities of the tags (time, tags) given scores ``s``, over all paths."""
        a, z = np.empty_like(s), np.zeros_like(s)
        a[0] = s[0]
        for i in range(1, len(s)):
            a[i] = s[i] + _logsum(a[i - 1][:, None] + self.w["next"], 0)
        for i in range(len(s) - 2, -1, -1):
            z[i] = _logsum(self.w["next"] + s[i + 1] + z[i + 1], 1)
        return np.exp(a + z - _logsum(a[-1], 0))
