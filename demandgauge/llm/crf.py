"""A linear-chain conditional random field over a few discrete features per token, in numpy.

Trained by Adam on padded sentences (forward-backward over all of them at once), decoded by
Viterbi over padded batches of segments of like length.  Label 0 is "outside".
"""

from __future__ import annotations

import numpy as np


class Crf:
    """``sizes``: how many values each feature has; labels are 0..n_labels-1."""

    def __init__(self, sizes: list[int], n_labels: int):
        self.tables = [np.zeros((n, n_labels)) for n in sizes]
        self.step = np.zeros((n_labels, n_labels))

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(t[f] for t, f in zip(self.tables, features, strict=True))

    def fit(self, sentences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 250, rate: float = 0.08, l2: float = 0.02) -> Crf:
        """``sentences``: (tokens, features) arrays."""
        n, longest, width = len(sentences), max(map(len, sentences)), len(self.tables)
        x = np.zeros((n, longest, width), dtype=np.int64)
        y, real = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
        for i, (s, tags) in enumerate(zip(sentences, labels, strict=True)):
            x[i, :len(s)], y[i, :len(s)], real[i, :len(s)] = s, tags, True
        weights = [*self.tables, self.step]
        moment, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        k = self.step.shape[0]
        pairs = real[:, 1:]
        for t in range(1, rounds + 1):
            e = sum(w[x[:, :, j]] for j, w in enumerate(self.tables))
            ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            ahead[:, 0] = e[:, 0]
            for i in range(1, longest):
                new = _log_sum(ahead[:, i - 1, :, None] + self.step[None]) + e[:, i]
                ahead[:, i] = np.where(real[:, i, None], new, ahead[:, i - 1])
            for i in range(longest - 2, -1, -1):
                new = _log_sum((self.step.T[None] + (e[:, i + 1] + behind[:, i + 1])[:, :, None]))
                behind[:, i] = np.where(real[:, i + 1, None], new, behind[:, i + 1])
            total = _log_sum(ahead[:, -1, :, None])
            of_label = np.exp(ahead + behind - total[:, None]) * real[:, :, None]
            of_pair = np.exp(ahead[:, :-1, :, None] + self.step + (e[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, :, None]) * pairs[..., None, None]
            hit = np.eye(k)[y] * real[:, :, None]
            gradients = []
            for j, w in enumerate(self.tables):
                g = np.zeros_like(w)
                np.add.at(g, x[:, :, j], hit - of_label)
                gradients.append(g - l2 * w)
            g = -of_pair.sum(axis=(0, 1))
            np.add.at(g, (y[:, :-1][pairs], y[:, 1:][pairs]), 1.0)
            gradients.append(g - l2 * self.step)
            for w, g, m, v in zip(weights, gradients, moment, square, strict=True):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                w += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        return self

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of segments; segment i has the rows first[i]:first[i+1] of ``e``.

        A segment in which no token can gain over "outside" by any label and any two steps is outside as
        a whole; that is a proof, not a guess, so such segments skip the search.
        """
        out = np.zeros(len(e), dtype=np.int8)
        sizes = np.diff(first)
        if not len(e):
            return out
        gain = e[:, 1:].max(axis=1) - e[:, 0] + 2 * max(0.0, float((self.step - self.step[0, 0]).max()))
        begin = first[:-1][sizes > 0]
        hopeful = np.flatnonzero(sizes > 0)[np.maximum.reduceat(gain, begin) > 0]
        width = np.ceil(np.log2(np.maximum(sizes[hopeful], 1)) * 2).astype(int)
        for w in np.unique(width):
            group = hopeful[width == w]
            most = max(1, (1 << 20) // int(sizes[group].max()))
            for i in range(0, len(group), most):
                self._viterbi(e, first[:-1][group[i:i + most]], sizes[group[i:i + most]], out)
        return out

    def _viterbi(self, e: np.ndarray, begin: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        longest, k = int(sizes.max()), e.shape[1]
        back = np.zeros((longest, len(begin), k), dtype=np.int8)
        score = e[begin]
        for i in range(1, longest):
            on = i < sizes
            options = score[:, :, None] + self.step[None]
            back[i] = options.argmax(axis=1)
            new = options.max(axis=1) + e[np.minimum(begin + i, len(e) - 1)]
            score = np.where(on[:, None], new, score)
        label = score.argmax(axis=1)
        for i in range(longest - 1, -1, -1):
            on = i < sizes
            out[begin[on] + i] = label[on]
            if i:
                label = np.where(on, back[i, np.arange(len(begin)), label], label)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over axis 1."""
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
