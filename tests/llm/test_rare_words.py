"""Words that share a token of the language model differ by their own counts, however many words there are."""

import math
import random

import numpy as np
import pytest

from evispark.llm import lm

S = lm.Settings(classes=4, shared=4, width=5, batch=64, chunks=4)


def test_junk_is_less_likely_than_rare_words(spark):
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(12)], [f"rare{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < .7 else rng.choice(rare) for _ in range(80))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    blocks = lm.cut(df, S)
    counts = lm.word_counts(blocks)
    vocab, flat = lm.train(blocks, counts, S)
    n = {r["word"]: r["n"] for r in counts.collect() if r["word"] not in vocab.tolist()}

    def hashed(w):
        return int(np.uint64(lm.xxh64_intdigest(w.encode())).view(np.int64))
    shared = {w for w in rare + common if hashed(w) in n}
    assert len(n) == len(shared) > 200
    prose, junk = " ".join(rng.sample(sorted(shared), 60)), " ".join(f"{rng.getrandbits(60):x}" for _ in range(60))
    rows = [(1, prose), (2, junk), (2, junk), (None, "c1 c2"), (3, None), (4, "")]
    asked = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lm.cut(asked, S)
    got, without = lm.score(cut, (vocab, flat), S, counts).collect(), lm.score(cut, (vocab, flat), S).collect()
    assert len(got) == len(rows)
    by, plain = {r["id"]: r for r in got}, {r["id"]: r for r in without}
    assert by[1]["score"] > by[2]["score"] + 0.5
    assert by[3]["score"] is None and by[4]["log_prob"] == 0
    want = plain[1]["log_prob"]
    for w in prose.split():
        of = [c for u, c in n.items() if u % S.shared == hashed(w) % S.shared]
        want += math.log((n[hashed(w)] + .5) / (sum(of) + (len(of) + 1) / 2))
    assert by[1]["log_prob"] == pytest.approx(want, abs=1e-2)


def test_rows_are_reduced_by_columns():
    """The same highest values, logarithms and shares as row by row."""
    x = np.random.default_rng(1).standard_normal((200, 32)).astype(np.float32) * 9
    at, rows = np.random.default_rng(2).integers(0, 32, 200), np.arange(200)
    assert np.array_equal(lm._highest(x), x.max(1, keepdims=True))
    e = np.exp(x.astype(np.float64))
    assert np.allclose(lm._softmax(x.copy()), e / e.sum(1, keepdims=True), atol=1e-6)
    assert np.allclose(lm._log_of(x.copy(), at), np.log(e[rows, at] / e.sum(1)), atol=1e-5)
    assert [lm.numbered()[w] for w in "ab"] == [0, 0]
    seen = lm.numbered()
    assert [seen[w] for w in "abac"] == [0, 1, 0, 2] and list(seen) == list("abc")
