"""A linear-chain conditional random field with two labels: training by gradient, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """``emit`` (features x labels), ``step`` (label to label), ``start`` (labels)."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, scores: list[list[float]]) -> list[int]:
        """The best label sequence for the lines' emission scores."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start.tolist()
        a, b = a + scores[0][0], b + scores[0][1]
        back = []
        for x, y in scores[1:]:
            stay, come = a + s00, b + s10
            go, keep = a + s01, b + s11
            back.append((stay < come, go < keep))
            a, b = max(stay, come) + x, max(go, keep) + y
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.2, ridge: float = 1e-3,
          longest: int = 48) -> Crf:
    """Maximum likelihood by Adam over sequences of (features, labels); long ones are learned in pieces."""
    pieces = [(x[i:i + longest], y[i:i + longest]) for x, y in sequences for i in range(0, len(y), longest)]
    n, width = len(pieces), pieces[0][0].shape[1]
    steps = max(len(y) for _, y in pieces)
    x, y, here = np.zeros((steps, n, width)), np.zeros((steps, n), np.int64), np.zeros((steps, n))
    for i, (px, py) in enumerate(pieces):
        x[:len(py), i], y[:len(py), i], here[:len(py), i] = px, py, 1.0
    onto = np.eye(2)[y] * here[..., None]
    pairs = here[1:] * here[:-1]
    seen_emit = np.einsum("tnf,tnl->fl", x, onto)
    seen_step = np.einsum("tnk,tnl,tn->kl", onto[:-1], onto[1:], pairs)
    seen_start = onto[0].sum(axis=0)
    total = here.sum()
    sizes = [(width, 2), (2, 2), (2,)]
    w = [np.zeros(s) for s in sizes]
    m, v = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for k in range(1, rounds + 1):
        emit, step, start = w
        e = x @ emit
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            new = _log_sum(alpha[t - 1][:, :, None] + step, 1) + e[t]
            alpha[t] = np.where(here[t][:, None] > 0, new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = _log_sum(step[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(here[t + 1][:, None] > 0, new, 0.0)
        z = _log_sum(alpha[-1], 1)
        gamma = np.exp(alpha + beta - z[None, :, None]) * here[..., None]
        both = np.exp(alpha[:-1][..., None] + step + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * pairs[..., None, None]
        grads = [np.einsum("tnf,tnl->fl", x, gamma) - seen_emit, both.sum(axis=(0, 1)) - seen_step, gamma[0].sum(axis=0) - seen_start]
        for i, g in enumerate(grads):
            g = g / total + ridge * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.99 ** k)) + 1e-8)
    return Crf(*w)
