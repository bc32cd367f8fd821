"""A linear-chain conditional random field with two labels and indicator features.

Training maximises the penalised log-likelihood of labelled sequences by
forward-backward passes over all of them at once; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class LinearChain:
    """``weights``: (features, 2); ``moves``: (2, 2) from label to label; ``begin``: (2,)."""

    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    @classmethod
    def empty(cls, n_features: int) -> LinearChain:
        return cls(np.zeros((n_features, 2)), np.zeros((2, 2)), np.zeros(2))

    def decode(self, emissions: np.ndarray) -> list[int]:
        """The most probable labels of one sequence; a tie goes to label 1.

        With two labels the path is carried as the difference of the two
        scores and a back pointer for each label.
        """
        (m00, m01), (m10, m11) = self.moves.tolist()
        rows = emissions.tolist()
        if not rows:
            return []
        a, b = rows[0][0] + self.begin[0], rows[0][1] + self.begin[1]
        back = []
        for e0, e1 in rows[1:]:
            from0 = 1 if b + m10 >= a + m00 else 0
            from1 = 1 if b + m11 >= a + m01 else 0
            a, b = e0 + (b + m10 if from0 else a + m00), e1 + (b + m11 if from1 else a + m01)
            back.append((from0, from1))
        label = 1 if b >= a else 0
        path = [label]
        for p in reversed(back):
            label = p[label]
            path.append(label)
        return path[::-1]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], n_features: int, steps: int = 150, rate: float = 0.1,
          penalty: float = 1.0, longest: int = 128) -> LinearChain:
    """Fits (features, labels) sequences: an int array (length, k) of indicator
    numbers, and 0/1 labels.  Sequences over ``longest`` are cut into several.
    Without any item, all weights are zero.
    """
    cut = [(f[i:i + longest], y[i:i + longest]) for f, y in sequences for i in range(0, len(y), longest) if len(y)]
    model = LinearChain.empty(n_features)
    if not cut:
        return model
    cut.sort(key=lambda s: -len(s[1]))
    lengths = np.array([len(y) for _, y in cut])
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    # Items in order of position, so that a position's items are one slice.
    feats = np.concatenate([np.stack([f[t] for f, _ in cut[:n]]) for t, n in enumerate(active)])
    labels = np.concatenate([np.array([y[t] for _, y in cut[:n]]) for t, n in enumerate(active)]).astype(int)
    at = np.concatenate(([0], np.cumsum(active)))
    n_items, width = feats.shape
    flat = feats.ravel()
    gold_w = np.stack([np.bincount(flat, np.repeat(labels == k, width), n_features) for k in (0, 1)], 1)
    gold_begin = np.bincount(labels[:active[0]], minlength=2).astype(float)
    gold_moves = np.zeros((2, 2))
    for t in range(1, len(active)):
        prev, here = labels[at[t - 1]:at[t - 1] + active[t]], labels[at[t]:at[t + 1]]
        np.add.at(gold_moves, (prev, here), 1)
    params = [model.weights, model.moves, model.begin]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, m, b = params
        e = w[feats].sum(1)
        alpha, beta = np.empty((n_items, 2)), np.zeros((n_items, 2))
        alpha[:active[0]] = e[:active[0]] + b
        for t in range(1, len(active)):
            alpha[at[t]:at[t + 1]] = e[at[t]:at[t + 1]] + _lse(alpha[at[t - 1]:at[t - 1] + active[t], :, None] + m, 1)
        for t in range(len(active) - 2, -1, -1):
            nxt = slice(at[t + 1], at[t + 2])
            beta[at[t]:at[t] + active[t + 1]] = _lse(m + (e[nxt] + beta[nxt])[:, None, :], 2)
        both = alpha + beta
        p = np.exp(both - _lse(both, 1)[:, None])
        grad_w = gold_w - np.stack([np.bincount(flat, np.repeat(p[:, k], width), n_features) for k in (0, 1)], 1)
        grad_m = gold_moves.copy()
        for t in range(1, len(active)):
            here = slice(at[t], at[t + 1])
            joint = alpha[at[t - 1]:at[t - 1] + active[t], :, None] + m + (e[here] + beta[here])[:, None, :]
            flat_joint = joint.reshape(-1, 4)
            grad_m -= np.exp(flat_joint - _lse(flat_joint, 1)[:, None]).sum(0).reshape(2, 2)
        grad_b = gold_begin - p[:active[0]].sum(0)
        for i, g in enumerate((grad_w, grad_m, grad_b)):
            g = (g - penalty * params[i]) / n_items
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return LinearChain(*params)
