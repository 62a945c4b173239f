"""All rounds of the language model's training together mask every token once."""

import numpy as np

from evispark.llm import lm


def test_every_token_is_a_target():
    s = lm.Settings()
    row, sizes = np.array([3, 900, 1000, 4, 4, 17, 5, 6, 7, 5, 6, 7, 8], np.uint16), np.array([5, 0, 1, 7])
    turns = [lm.fold(row, sizes, k, s) for k in range(s.rounds)]
    assert sorted(np.concatenate(turns).tolist()) == list(range(13)) and all(len(t) for t in turns)
    assert len(lm.fold(row[:0], sizes[:0], 0, s)) == 0
    # a document's mask is its own, wherever it stands
    alone = [lm.fold(row[6:], sizes[3:], k, s) + 6 for k in range(s.rounds)]
    assert all(np.array_equal(t[t >= 6], u) for t, u in zip(turns, alone))
