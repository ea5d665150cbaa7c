"""The shortcut of the Viterbi search against every path."""

from itertools import product

import numpy as np

from featmart.llm.crf import Crf


def test_tags_disfavoured_from_every_neighbour():
    rng = np.random.default_rng(7)
    cases = [(np.array([[0.0, -5], [5, 0]]), np.array([[0.0, -2], [0, -100]]))]
    for _ in range(300):
        moves = rng.normal(0, 3, (3, 3))
        moves[:, 0] -= 6
        moves[1] -= 6
        cases.append((moves, rng.normal(0, 4, (int(rng.integers(1, 6)), 3))))
    for moves, scores in cases:
        def total(path):
            return sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

        found = Crf(np.zeros((1, len(moves))), moves).decode(scores, np.array([0, len(scores)]))
        assert np.isclose(total(found), max(map(total, product(range(len(moves)), repeat=len(scores)))))
