"""Linear-chain conditional random field with two labels, in numpy.

Sequences of a batch stand one after another; ``first`` marks where each
begins. A sequence start is a step that forgets the label before it, so one
scan serves all sequences, however long: the scan works on blocks in parallel
and links the blocks afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: features x 2, transitions 2 x 2, start 2."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def steps(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Potential of (label before, label) at every position, n x 2 x 2."""
        unary = x @ self.weights
        link = np.where(first[:, None, None], self.start[None, None, :], self.transitions[None])
        score = unary[:, None, :] + link
        return np.exp(score - score.max(axis=(1, 2), keepdims=True))

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) per position (n x 2) and P(label before, label) (n x 2 x 2)."""
        m = self.steps(x, first)
        n = len(m)
        if not n:
            return np.zeros((0, 2)), np.zeros((0, 2, 2))
        ahead = _scan(m)
        back = _scan(np.ascontiguousarray(m[::-1].transpose(0, 2, 1)))[::-1]
        # back[t] holds the message into the label before t; the last step has none after it.
        after = np.ones((n, 2))
        after[:-1] = back[1:]
        node = ahead * after
        node /= node.sum(axis=1, keepdims=True)
        before = np.full((n, 2), 0.5)
        before[1:] = ahead[:-1]
        pair = before[:, :, None] * m * after[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return node, pair

    def best(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Viterbi labels of sequences with the given lengths, all at once."""
        unary = x @ self.weights
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        score = np.zeros((len(order), 2))
        came = np.zeros((len(unary), 2), dtype=np.int8)
        for t in range(longest):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            at = begin[order[:live]] + t
            if t == 0:
                score[:live] = self.start + unary[at]
                continue
            options = score[:live, :, None] + self.transitions[None]
            came[at] = options.argmax(axis=1)
            score[:live] = options.max(axis=1) + unary[at]
        labels = np.zeros(len(unary), dtype=np.int8)
        now = score.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            at = begin[order[:live]] + t
            labels[at] = now[:live]
            now[:live] = came[at, now[:live]]
        return labels


def _scan(m: np.ndarray) -> np.ndarray:
    """Normalised running products v * m[0] * ... * m[t] for every t, n x 2."""
    n = len(m)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    padded = np.zeros((blocks * width, 2, 2))
    padded[:n] = m
    padded[n:] = np.eye(2)
    steps = padded.reshape(blocks, width, 2, 2).transpose(1, 2, 3, 0).copy()
    # Product of each block.
    a, b, c, d = (steps[0][i, j].copy() for i in (0, 1) for j in (0, 1))
    for t in range(1, width):
        s = steps[t]
        a, b = a * s[0, 0] + b * s[1, 0], a * s[0, 1] + b * s[1, 1]
        c, d = c * s[0, 0] + d * s[1, 0], c * s[0, 1] + d * s[1, 1]
        z = 1.0 / (a + b + c + d)
        a, b, c, d = a * z, b * z, c * z, d * z
    # State before each block.
    u, v = np.empty(blocks), np.empty(blocks)
    p, q = 0.5, 0.5
    for k in range(blocks):
        u[k], v[k] = p, q
        p, q = p * a[k] + q * c[k], p * b[k] + q * d[k]
        z = p + q
        p, q = p / z, q / z
    out = np.empty((width, 2, blocks))
    for t in range(width):
        s = steps[t]
        u, v = u * s[0, 0] + v * s[1, 0], u * s[0, 1] + v * s[1, 1]
        z = 1.0 / (u + v)
        u, v = u * z, v * z
        out[t, 0], out[t, 1] = u, v
    return out.transpose(2, 0, 1).reshape(blocks * width, 2)[:n]


def fit(
    x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3
) -> Chain:
    """Penalised maximum likelihood by Adam over exact gradients; deterministic."""
    f = x.shape[1]
    theta = np.zeros(f * 2 + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((len(y), 2))
    gold[np.arange(len(y)), y] = 1.0
    real = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(real, (y[inner - 1], y[inner]), 1.0)
    n = max(1, len(y))
    for k in range(1, rounds + 1):
        chain = unpack(theta, f)
        node, pair = chain.marginals(x, first)
        miss = gold - node
        grad = np.concatenate(
            [(x.T @ miss).ravel(), (real - pair[inner].sum(axis=0)).ravel(), miss[first].sum(axis=0)]
        ) / n - ridge * theta / np.sqrt(n)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta = theta + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return unpack(theta, f)


def unpack(theta: np.ndarray, f: int) -> Chain:
    return Chain(theta[: 2 * f].reshape(f, 2), theta[2 * f : 2 * f + 4].reshape(2, 2), theta[2 * f + 4 :])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic fit (Newton, small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -4, 4)
    return float(a), float(b)
