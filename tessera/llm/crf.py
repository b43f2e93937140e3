"""Linear-chain conditional random field with two labels over sequences of binary features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LinearChain:
    """Weights per feature and label; transitions[a][b], start and stop scores of labels."""

    weights: dict[str, tuple[float, float]]
    transitions: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]
    stop: tuple[float, float]

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi; label 0 on a tie."""
        if not sequence:
            return []
        weights, ((t00, t01), (t10, t11)) = self.weights, self.transitions
        zero = (0.0, 0.0)
        back = []
        a, b = self.start
        for k, features in enumerate(sequence):
            e0 = e1 = 0.0
            for f in features:
                w = weights.get(f, zero)
                e0 += w[0]
                e1 += w[1]
            if not k:
                a, b = a + e0, b + e1
                continue
            from0, from1 = a + t00, b + t10
            to0, to1 = a + t01, b + t11
            back.append((from1 > from0, to1 > to0))
            a, b = max(from0, from1) + e0, max(to0, to1) + e1
        label = int(b + self.stop[1] > a + self.stop[0])
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def _forward_backward(e: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Log partition, label marginals (n, 2) and summed pair marginals (2, 2)."""
    n = len(e)
    alpha, beta = np.empty((n, 2)), np.empty((n, 2))
    alpha[0] = start + e[0]
    for k in range(1, n):
        alpha[k] = np.logaddexp(alpha[k - 1, 0] + t[0], alpha[k - 1, 1] + t[1]) + e[k]
    beta[-1] = stop
    for k in range(n - 2, -1, -1):
        ahead = beta[k + 1] + e[k + 1]
        beta[k] = np.logaddexp(t[:, 0] + ahead[0], t[:, 1] + ahead[1])
    z = np.logaddexp(*(alpha[-1] + stop))
    pairs = np.exp(alpha[:-1, :, None] + t[None] + (beta[1:] + e[1:])[:, None, :] - z).sum(0)
    return z, np.exp(alpha + beta - z), pairs


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.5, l2: float = 1e-4) -> LinearChain:
    """Fit on labelled sequences by adaptive gradient ascent on the conditional log-likelihood."""
    names = {f: k for k, f in enumerate(dict.fromkeys(f for seq, _ in pages for fs in seq for f in fs))}
    w = np.zeros((len(names), 2))
    chain = np.zeros((4, 2))  # transitions, start, stop
    g_w, g_c = np.full_like(w, 1e-6), np.full_like(chain, 1e-6)
    coded = []
    for seq, labels in pages:
        if seq:
            at = np.array([names[f] for fs in seq for f in fs])
            owner = np.repeat(np.arange(len(seq)), [len(fs) for fs in seq])
            coded.append((at, owner, np.array(labels)))
    draw = np.random.default_rng(5)
    for _ in range(rounds):
        for k in draw.permutation(len(coded)):
            at, owner, y = coded[k]
            e = np.zeros((len(y), 2))
            np.add.at(e, owner, w[at])
            _, marginal, pairs = _forward_backward(e, chain[:2], chain[2], chain[3])
            truth = np.eye(2)[y]
            miss = truth - marginal
            grad = np.zeros_like(chain)
            np.add.at(grad, y[:-1], truth[1:])
            grad[:2] -= pairs
            grad[2], grad[3] = miss[0], miss[-1]
            grad -= l2 * chain
            g_c += grad**2
            chain += rate * grad / np.sqrt(g_c)
            rows, back = np.unique(at, return_inverse=True)
            step = np.zeros((len(rows), 2))
            np.add.at(step, back, miss[owner])
            step -= l2 * w[rows]
            g_w[rows] += step**2
            w[rows] += rate * step / np.sqrt(g_w[rows])
    as_pair = lambda row: (float(row[0]), float(row[1]))
    return LinearChain({f: as_pair(w[k]) for f, k in names.items()}, (as_pair(chain[0]), as_pair(chain[1])), as_pair(chain[2]), as_pair(chain[3]))
