"""A linear-chain conditional random field over feature ids, in numpy batches.

An item has a fixed number of feature ids; its score for a tag is the sum of their
weights, and two neighbours add the weight of their tags' transition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells (sequences x steps) decoded at a time.
BATCH_CELLS = 1 << 18


@dataclass
class Crf:
    weights: np.ndarray  # (features, tags)
    moves: np.ndarray  # (tags, tags): from, to

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(items, tags) of items' feature ids (items, ids)."""
        out = np.zeros((len(features), self.weights.shape[1]), dtype=np.float32)
        for column in features.T:
            out += self.weights[column]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of sequences laid end to end; sequence i is first[i]:first[i + 1].

        An item whose best tag leads each other by more than that one's transitions to
        both sides can ever make up for has its best tag on every best path. Such items
        cut the chains; only the runs between them are searched, in batches of similar
        length. The result is that of a search over the whole sequences.
        """
        count = len(scores)
        if not count:
            return np.zeros(0, dtype=np.int8)
        best = scores.argmax(axis=1)
        tags = best.astype(np.int8)
        # gain[b, y]: the most that tag y can win over tag b by its transitions.
        into = self.moves.T[None, :, :] - self.moves.T[:, None, :]
        onto = self.moves[None, :, :] - self.moves[:, None, :]
        # A side without a neighbour adds 0, which bounds a negative maximum.
        gain = np.maximum(into.max(axis=2), 0) + np.maximum(onto.max(axis=2), 0) + 1e-4
        np.fill_diagonal(gain, -np.inf)
        lead = np.take_along_axis(scores, best[:, None], axis=1) - scores
        open_ = (lead <= gain[best]).any(axis=1)
        if not open_.any():
            return tags
        begins = np.zeros(count + 1, dtype=bool)
        begins[first] = True
        starts = np.flatnonzero(open_ & (begins[:-1] | ~np.concatenate([[False], open_[:-1]])))
        ends = np.flatnonzero(open_ & (begins[1:] | ~np.concatenate([open_[1:], [False]]))) + 1
        before = np.where(begins[starts], -1, tags[np.maximum(starts - 1, 0)])
        last = begins[ends]
        after = np.where(last, -1, tags[np.minimum(ends, count - 1)])
        for group in _groups(ends - starts):
            self._search(scores, tags, starts[group], ends[group], before[group], after[group])
        return tags

    def _search(self, scores, tags, starts, ends, before, after) -> None:
        """Best tags of the runs, given the fixed tag on either side (-1 for none)."""
        length = ends - starts
        steps, kinds = int(length.max()), self.moves.shape[0]
        lead_in = np.vstack([self.moves, np.zeros(kinds)])[before]
        lead_out = np.hstack([self.moves, np.zeros((kinds, 1))])[:, after].T
        at = np.minimum(starts[:, None] + np.arange(steps), len(scores) - 1)
        score = scores[at[:, 0]] + lead_in + np.where((length == 1)[:, None], lead_out, 0)
        back = np.zeros((steps, len(starts), kinds), dtype=np.int8)
        final = score.copy()
        for t in range(1, steps):
            ways = score[:, :, None] + self.moves
            back[t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + scores[at[:, t]]
            ending = length == t + 1
            score = np.where(ending[:, None], score + lead_out, score)
            final = np.where(ending[:, None], score, final)
        tag = final.argmax(axis=1)
        rows = np.arange(len(starts))
        for t in range(steps - 1, -1, -1):
            inside = t < length
            tags[at[inside, t]] = tag[inside]
            if t:
                tag = np.where(inside, back[t, rows, tag], tag)


def _groups(length: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of similar length: padding at most doubles a batch."""
    order = np.argsort(-length, kind="stable")
    low = 0
    while low < len(order):
        most = int(length[order[low]])
        high = int(np.searchsorted(-length[order], -(most // 2), side="left")) if most > 1 else len(order)
        high = max(low + 1, min(high, low + max(1, BATCH_CELLS // most)))
        yield order[low:high]
        low = high


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(first)
    steps = int(length.max())
    inside = np.arange(steps) < length[:, None]
    return np.where(inside, first[:-1, None] + np.arange(steps), 0), inside


def _sum_exp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def fit(
    features: np.ndarray,
    tags: np.ndarray,
    first: np.ndarray,
    n_features: int,
    n_tags: int,
    rounds: int = 80,
    ridge: float = 1e-3,
    rate: float = 0.2,
    longest: int = 32,
) -> Crf:
    """Maximum likelihood with a ridge penalty, by full-batch Adam steps from zero.

    Sequences of more than `longest` items are learned from as several. Deterministic. The
    table must fit the driver; callers bound it.
    """
    first = np.unique(np.concatenate([np.arange(low, high, longest) for low, high in zip(first[:-1], first[1:])] + [first[-1:]]))
    model = Crf(np.zeros((n_features, n_tags), dtype=np.float32), np.zeros((n_tags, n_tags)))
    if not len(tags):
        return model
    at, inside = _padded(first)
    seqs, steps = at.shape
    last = np.diff(first) - 1
    truth = np.zeros((len(tags), n_tags))
    truth[np.arange(len(tags)), tags] = 1
    same = np.ones(len(tags), dtype=bool)
    same[first[:-1]] = False
    pair = np.zeros((n_tags, n_tags))
    follow = np.flatnonzero(same)
    np.add.at(pair, (tags[follow - 1], tags[follow]), 1)
    moments = [np.zeros((n_features, n_tags)), np.zeros((n_features, n_tags)), np.zeros((n_tags, n_tags)), np.zeros((n_tags, n_tags))]
    for turn in range(1, rounds + 1):
        score = model.scores(features).astype(np.float64)
        grid = score[at]
        ahead = np.zeros((steps, seqs, n_tags))
        ahead[0] = grid[:, 0]
        for t in range(1, steps):
            step = _sum_exp(ahead[t - 1][:, :, None] + model.moves, 1) + grid[:, t]
            ahead[t] = np.where(inside[:, t, None], step, ahead[t - 1])
        behind = np.zeros((steps, seqs, n_tags))
        for t in range(steps - 2, -1, -1):
            step = _sum_exp(model.moves + (grid[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where((t < last)[:, None], step, 0)
        norm = _sum_exp(ahead[-1], 1)
        chance = np.exp(ahead + behind - norm[:, None])
        expected = np.zeros_like(pair)
        for t in range(1, steps):
            joint = ahead[t - 1][:, :, None] + model.moves + (grid[:, t] + behind[t])[:, None, :] - norm[:, None, None]
            expected += np.exp(joint[inside[:, t]]).sum(axis=0)
        off = truth - chance.transpose(1, 0, 2)[inside]
        slope = np.zeros((n_features, n_tags))
        for column in features.T:
            for tag in range(n_tags):
                slope[:, tag] += np.bincount(column, weights=off[:, tag], minlength=n_features)
        slopes = (slope / len(tags) - ridge * model.weights, (pair - expected) / len(tags) - ridge * model.moves)
        for i, (gradient, target) in enumerate(zip(slopes, (model.weights, model.moves))):
            mean, square = moments[2 * i], moments[2 * i + 1]
            mean += 0.1 * (gradient - mean)
            square += 0.02 * (gradient**2 - square)
            target += rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.98**turn)) + 1e-8)
    return model
