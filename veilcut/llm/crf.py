"""A linear-chain CRF with two labels: maximum likelihood by forward-backward, decoding by Viterbi."""

from __future__ import annotations

import math

import numpy as np


class Chain:
    """weight: score of label 1 for each feature; step[a][b]: score of label b after label a."""

    def __init__(self, weight: dict[str, float], step: list[list[float]], begin: list[float]):
        self.weight, self.step, self.begin = weight, step, begin

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels for the scores of label 1 (label 0 scores 0)."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step
        a, b, back = self.begin[0], self.begin[1] + scores[0], []
        for x in scores[1:]:
            to0 = (a + s00, 0) if a + s00 >= b + s10 else (b + s10, 1)
            to1 = (a + s01, 0) if a + s01 > b + s11 else (b + s11, 1)
            a, b = to0[0], to1[0] + x
            back.append((to0[1], to1[1]))
        label = [1 if b > a else 0]
        for prev in reversed(back):
            label.append(prev[label[-1]])
        return label[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], l2: float = 0.02, rounds: int = 150, rate: float = 0.15) -> Chain:
    """Fit by full-batch Adam on the mean log-likelihood of (features of each block, labels); deterministic."""
    names = sorted({f for blocks, _ in pages for x in blocks for f in x})
    index = {f: i for i, f in enumerate(names)}
    n, t = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, t, len(names)), np.float32)
    y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (blocks, labels) in enumerate(pages):
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for k, own in enumerate(blocks):
            for f in own:
                x[i, k, index[f]] += 1
    flat = x.reshape(n * t, -1)
    w, step, begin = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    true_step = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            true_step[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    true_begin = np.bincount(y[:, 0], minlength=2)
    last = mask.sum(1) - 1
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, step, begin)]
    for r in range(1, rounds + 1):
        e = np.zeros((n, t, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = begin + e[:, 0]
        for k in range(1, t):
            alpha[:, k] = e[:, k] + np.logaddexp(alpha[:, k - 1, :1] + step[0], alpha[:, k - 1, 1:] + step[1])
        for k in range(t - 2, -1, -1):
            after = e[:, k + 1] + beta[:, k + 1]
            value = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            beta[:, k] = np.where((k < last)[:, None], value, 0)
        z = np.logaddexp(alpha[np.arange(n), last, 0], alpha[np.arange(n), last, 1])
        p1 = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
        p0 = np.exp(alpha[:, 0] + beta[:, 0] - z[:, None])
        pair = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                score = alpha[:, :-1, a] + step[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                pair[a, b] = np.exp(np.where(mask[:, 1:], score, -np.inf)).sum()
        grads = [flat.T @ (np.where(mask, y, 0) - p1).reshape(-1).astype(np.float32) / n - l2 * w, (true_step - pair) / n - l2 * step, (true_begin - p0.sum(0)) / n - l2 * begin]
        for p, g, (m, v) in zip((w, step, begin), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    if not math.isfinite(float(z.sum())):
        raise ArithmeticError("the likelihood isn't finite")
    return Chain({f: float(w[i]) for f, i in index.items()}, step.tolist(), begin.tolist())
