"""A character tagger in numpy: bidirectional LSTM, linear-chain CRF, trained by Adam.

Windows of code points go in, a tag per character comes out. Tag 0 is outside;
kind k has tags 2k+1 (begin) and 2k+2 (inside).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Input symbols: ASCII as it is, then other letters, other marks, and the edge of a text.
LETTER, OTHER, EDGE, SYMBOLS = 128, 129, 130, 131


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 128, points, OTHER).astype(np.int64)
    high = np.nonzero(points >= 128)[0]
    if len(high):
        out[high] = [LETTER if text[i].isalpha() else OTHER for i in high.tolist()]
    return out


@dataclass
class Tagger:
    """Parameters by name; ``fx``/``fh``/``fb`` run forward, ``bx``/``bh``/``bb`` backward."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, kinds: int, hidden: int, seed: int) -> Tagger:
        rng, tags = np.random.default_rng(seed), 2 * kinds + 1
        scale = 1 / np.sqrt(hidden)
        p = {}
        for d in "fb":
            p[d + "x"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
            p[d + "h"] = rng.normal(0, scale, (hidden, 4 * hidden))
            p[d + "b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["out"] = rng.normal(0, scale, (2 * hidden, tags))
        p["bias"] = np.zeros(tags)
        p["trans"] = np.zeros((tags, tags))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @property
    def tags(self) -> int:
        return len(self.p["bias"])

    def legal(self) -> np.ndarray:
        """0 where a tag may follow, far below where an inside tag follows the wrong one."""
        bad = np.zeros((self.tags, self.tags), np.float32)
        for inside in range(2, self.tags, 2):
            bad[:, inside] = -1e4
            bad[[inside - 1, inside], inside] = 0
        return bad

    def _lstm(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [time, batch, both directions] of symbols [batch, time]; the backward one reads from the end."""
        wx = np.stack([self.p["fx"] + self.p["fb"], self.p["bx"] + self.p["bb"]])
        wh = np.stack([self.p["fh"], self.p["bh"]])
        n, width = x.shape
        hidden = wh.shape[1]
        h, c = np.zeros((2, n, hidden), wh.dtype), np.zeros((2, n, hidden), wh.dtype)
        out, tape = np.empty((width, n, 2 * hidden), wh.dtype), []
        for t in range(width):
            a = h @ wh
            a[0] += wx[0][x[:, t]]
            a[1] += wx[1][x[:, width - 1 - t]]
            a[..., : 3 * hidden] *= 0.5
            np.tanh(a, out=a)
            gates = a[..., : 3 * hidden]
            gates += 1
            gates *= 0.5  # the logistic curve by tanh
            i, f, o, g = (a[..., k * hidden : (k + 1) * hidden] for k in range(4))
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t, :, :hidden], out[width - 1 - t, :, hidden:] = h
            if keep:
                tape.append((i, f, o, g, tc, before, old))
        return out, tape

    def _lstm_grad(self, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
        wh = np.stack([self.p["fh"], self.p["bh"]])
        back, (n, width), hidden = wh.transpose(0, 2, 1), x.shape, wh.shape[1]
        dh, dc = np.zeros((2, n, hidden), wh.dtype), np.zeros((2, n, hidden), wh.dtype)
        dwh, steps = np.zeros_like(wh), np.empty((2, width, n, 4 * hidden), wh.dtype)
        for t in range(width - 1, -1, -1):
            i, f, o, g, tc, before, old = tape[t]
            dh[0] += dout[t, :, :hidden]
            dh[1] += dout[width - 1 - t, :, hidden:]
            dc += dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            steps[:, t] = da
            dwh += before.transpose(0, 2, 1) @ da
            dh, dc = da @ back, dc * f
        for k, d in enumerate("fb"):
            flat, which = steps[k].reshape(-1, 4 * hidden), (x if d == "f" else x[:, ::-1]).T.reshape(-1)
            by = np.argsort(which, kind="stable")
            firsts = np.nonzero(np.concatenate(([True], np.diff(which[by]) != 0)))[0]
            dwx = np.zeros_like(self.p[d + "x"])
            dwx[which[by][firsts]] = np.add.reduceat(flat[by], firsts, axis=0)
            grad[d + "x"], grad[d + "h"], grad[d + "b"] = dwx, dwh[k], flat.sum(axis=0)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores [time, batch, tag]."""
        return self._lstm(x, False)[0] @ self.p["out"] + self.p["bias"]

    def _chains(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward chains, scaled to sum 1 forward; what enters each step; log partition of each window."""
        follows, top = np.exp(self.p["trans"] + self.legal()), e.max(axis=2, keepdims=True)
        x = np.exp(e - top)
        alpha, beta, scale = np.empty_like(x), np.ones_like(x), np.empty_like(top)
        now = x[0] * ((np.arange(self.tags) % 2 == 1) | (np.arange(self.tags) == 0))
        for t in range(len(e)):
            if t:
                now = (alpha[t - 1] @ follows) * x[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            alpha[t] = now / scale[t]
        x /= scale
        for t in range(len(e) - 2, -1, -1):
            beta[t] = (beta[t + 1] * x[t + 1]) @ follows.T
        return alpha, beta, x, (np.log(scale) + top).sum(axis=(0, 2))

    def marginals(self, e: np.ndarray) -> np.ndarray:
        alpha, beta, _, _ = self._chains(e)
        return alpha * beta

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi tags [batch, time]."""
        trans = self.p["trans"] + self.legal()
        best = e[0] + np.where((np.arange(self.tags) % 2 == 0) & (np.arange(self.tags) > 0), -1e4, 0)
        back = np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            step = best[:, :, None] + trans
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[t]
        out = np.empty((e.shape[1], len(e)), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(out))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def loss_and_grad(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y [batch, time] and its gradient."""
        n, width = x.shape
        both, tape = self._lstm(x, True)
        e = both @ self.p["out"] + self.p["bias"]
        alpha, beta, into, z = self._chains(e)
        trans = self.p["trans"] + self.legal()
        times, rows = np.arange(width)[:, None], np.arange(n)[None, :]
        gold = e[times, rows, y.T].sum(axis=0) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = alpha * beta
        ends = (into * beta)[1:].reshape(-1, self.tags)
        dtrans = np.exp(trans) * (alpha[:-1].reshape(-1, self.tags).T @ ends)
        np.subtract.at(dtrans, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
        de[times, rows, y.T] -= 1
        grad = {"trans": dtrans / n, "bias": de.sum(axis=(0, 1)) / n}
        flat = de.reshape(-1, self.tags)
        grad["out"] = both.reshape(-1, both.shape[2]).T @ flat / n
        self._lstm_grad(x, tape, de @ self.p["out"].T / n, grad)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam with gradient clipping; returns the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            slow = rate * (1 - epoch / (epochs + 1))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, grad = self.loss_and_grad(x[part], y[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                total += loss * len(part)
            losses.append(total / len(x))
        return losses
