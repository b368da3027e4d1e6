"""A linear-chain conditional random field in numpy: training by stochastic gradients, decoding by Viterbi in batches.

Sequences are lists of feature-name lists; training keeps the features it has seen. Everything is seeded, so the same
table gives the same model.
"""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Crf:
    def __init__(self, labels: list[str]) -> None:
        self.labels, k = labels, len(labels)
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, k))
        self.trans, self.first = np.zeros((k, k)), np.zeros(k)

    def train(self, table: list[tuple[list[list[str]], list[int]]], epochs: int = 10, batch: int = 64, rate: float = 0.25, decay: float = 2e-5, seed: int = 11) -> None:
        """Log-likelihood with AdaGrad. A step costs the batch's tokens times features; the model is dense in labels."""
        k = len(self.labels)
        for rows, _ in table:
            for feats in rows:
                for f in feats:
                    self.index.setdefault(f, len(self.index))
        n = len(self.index)
        w, trans, first = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        gw, gt, gf = np.full((n, k), 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)
        by_size = sorted(range(len(table)), key=lambda i: len(table[i][1]))
        groups = [self._batch([table[i] for i in by_size[at : at + batch]]) for at in range(0, len(by_size), batch)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                mask, y, owner, rows, where = groups[g]
                b, t = mask.shape
                own = w[rows]
                emit = np.stack([np.bincount(owner, weights=own[where, j], minlength=b * t) for j in range(k)], axis=1).reshape(b, t, k)
                p, pair = self._marginals(emit, mask, trans, first)
                ge = -p
                ge[np.arange(b)[:, None], np.arange(t)[None, :], y] += 1
                ge[~mask] = 0
                ge = ge.reshape(b * t, k)
                both = mask[:, 1:]
                gtr = -pair
                np.add.at(gtr, (y[:, :-1][both], y[:, 1:][both]), 1)
                gfi = np.bincount(y[:, 0], minlength=k) - p[:, 0].sum(axis=0)
                gr = np.stack([np.bincount(where, weights=ge[owner, j], minlength=len(rows)) for j in range(k)], axis=1) - decay * b * own
                gw[rows] += gr**2
                w[rows] = own + rate * gr / np.sqrt(gw[rows])
                gt += gtr**2
                trans += rate * gtr / np.sqrt(gt)
                gf += gfi**2
                first += rate * gfi / np.sqrt(gf)
        self.weight, self.trans, self.first = w, trans, first

    def _batch(self, part: list[tuple[list[list[str]], list[int]]]) -> tuple[np.ndarray, ...]:
        """Mask and labels of a batch, and for each feature of each token the token's place and the feature's row."""
        b, t = len(part), max(len(y) for _, y in part)
        mask, y = np.zeros((b, t), dtype=bool), np.zeros((b, t), dtype=int)
        ids: list[int] = []
        at, size = [], []
        for r, (rows, lab) in enumerate(part):
            mask[r, : len(lab)], y[r, : len(lab)] = True, lab
            for c, feats in enumerate(rows):
                ids += [self.index[f] for f in feats]
                at.append(r * t + c)
                size.append(len(feats))
        rows, where = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
        return mask, y, np.repeat(at, size), rows, where

    @staticmethod
    def _marginals(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, t, k = emit.shape
        fwd, bwd = np.zeros((b, t, k)), np.zeros((b, t, k))
        fwd[:, 0] = first + emit[:, 0]
        for i in range(1, t):
            new = _logsumexp(fwd[:, i - 1, :, None] + trans, 1) + emit[:, i]
            fwd[:, i] = np.where(mask[:, i, None], new, fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = _logsumexp(trans[None] + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(mask[:, i + 1, None], new, 0.0)
        z = _logsumexp(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            x = np.exp(fwd[:, i - 1, :, None] + trans + (emit[:, i] + bwd[:, i])[:, None, :] - z[:, None, None])
            pair += x[mask[:, i]].sum(axis=0)
        return p, pair

    def score(self, feats: list[str]) -> np.ndarray:
        """The sum of the weights of the known features."""
        ids = [i for i in map(self.index.get, feats) if i is not None]
        return self.weight[ids].sum(axis=0) if ids else np.zeros(len(self.labels))

    def sway(self) -> np.ndarray:
        """For each label the most that a path may win on transitions by taking it in one place instead of the first one."""
        into = np.concatenate([self.trans, self.first[None]])
        out = np.concatenate([self.trans, np.zeros((len(self.labels), 1))], axis=1)
        return (into - into[:, :1]).max(axis=0) + (out - out[:1]).max(axis=1)

    def viterbi(self, emits: list[np.ndarray], size: int = 256) -> list[np.ndarray]:
        """The best label sequences; sequences of like length share a batch, a step works on all of it."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(emits)
        order = sorted((i for i in range(len(emits)) if len(emits[i])), key=lambda i: len(emits[i]))
        into, first = np.ascontiguousarray(self.trans.T.astype(np.float32)), self.first.astype(np.float32)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            lens = np.array([len(emits[i]) for i in part])
            b, t, k = len(part), int(lens.max()), len(self.labels)
            emit = np.zeros((t, b, k), dtype=np.float32)
            for r, i in enumerate(part):
                emit[: lens[r], r] = emits[i]
            back = np.zeros((t, b, k), dtype=np.int8)
            now = emit[0] + first
            for i in range(1, t):
                live = slice(int(np.searchsorted(lens, i, "right")), b)  # sorted by length: the longer ones are last
                x = now[live, None, :] + into
                back[i, live] = best = x.argmax(axis=2)
                now[live] = np.take_along_axis(x, best[:, :, None], 2)[:, :, 0] + emit[i, live]
            lab = now.argmax(axis=1).astype(np.int8)
            y = np.zeros((t, b), dtype=np.int8)
            rows = np.arange(b)
            for i in range(t - 1, -1, -1):
                y[i] = lab
                live = lens > i
                lab = np.where(live, back[i, rows, lab], lab) if i else lab
            for r, i in enumerate(part):
                out[i] = y[: lens[r], r]
        return out
