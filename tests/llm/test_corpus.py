"""Languages, language-model scores and mixing: held-out accuracy, plain versions, hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import language, lm, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_counts(text, s):
    low, total = text.lower(), Counter()
    for i in range(len(low)):
        gram = 0
        for n in range(s.longest):
            if i + n < len(low):
                gram = (gram * 1000003 + ord(low[i + n]) + n + 1) % (1 << 64)
                total[(gram * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % s.dims] += 1
    return total


def test_ngram_counts(monkeypatch):
    s = language.Settings(dims=512)
    for block in (1 << 18, 5):
        monkeypatch.setattr(language, "BLOCK", block)
        for text in ("", "a", "ab", "Ünïcode 𝒳 text\n", "hello there general"):
            assert {i: c for i, c in enumerate(language.counts(text, s)) if c} == dict(plain_counts(text, s))


def test_language_accuracy_on_held_out(documents):
    model = language.train(documents)
    rows = language.identify(documents, model).join(documents.withColumnRenamed("doc_id", "id"), "id").collect()
    part = {r["id"]: zlib.crc32(str(r["id"]).encode()) % 3 for r in rows}
    assert all(r["held_out"] == (part[r["id"]] == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (model.weights == 0).mean() > 0.5


def test_language_of_hard_rows(spark, documents):
    rows = [(None, None, None, 1), (1, "", "en", 1), (2, "123 !?", "en", 1), (3, "the and of with this that", None, 1), (3, "the and of with this that", None, 1),
            (4, "x" * 600000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.train(documents)
    got = language.identify(df, model).collect()
    assert sorted(r["lang_pred"] for r in got)[-3:] == ["und"] * 3 and len(got) == 6
    assert sorted(r["lang_pred"] for r in got if r["id"] == 3) == ["en", "en"]
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_labels_of_held_out_rows_are_not_learned(spark, documents):
    model = language.train(documents)
    turned = documents.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    other = language.train(turned)
    assert other.labels == model.labels and np.array_equal(other.weights, model.weights) and other.temperature == model.temperature


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(1)
    scores = rng.standard_normal((4000, 3)) * 2
    truth = np.array([rng.choice(3, p=p) for p in language.softmax(scores)])
    assert language.calibrate(scores * 5, truth) == pytest.approx(5, rel=0.1)


SMALL = lm.Settings(classes=4, shared=4, width=5, batch=64, chunks=4)


def plain_token(word, vocab, s):
    h = int(np.uint64(lm.xxh64_intdigest(word)).view(np.int64))
    return vocab.index(h) if h in vocab else s.tokens - s.shared + h % s.shared


def plain_score(text, vocab, flat, s):
    """Each word from the two on either side, one at a time."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    ids = [s.tokens] * s.span + [plain_token(w, vocab, s) for w in words] + [s.tokens] * s.span
    tables, bias, outer, outer_bias, inner, inner_bias = [x.astype(float) for x in lm.split(flat, s)]
    total = 0.0
    for i in range(s.span, len(ids) - s.span):
        around = ids[i - s.span:i] + ids[i + 1:i + s.span + 1]
        h = np.tanh(bias + sum(tables[k][x] for k, x in enumerate(around)))
        c, j = divmod(ids[i], s.classes)
        for logits, at in ((h @ outer + outer_bias, c), (h @ inner[c] + inner_bias[c], j)):
            total += logits[at] - math.log(np.exp(logits).sum())
    return len(words), total


def test_scores_are_sums_over_tokens(spark):
    vocab = np.array([lm.xxh64_intdigest(w) for w in (b"two", b"one", b"four", b"\xc3\xbc")], np.uint64).view(np.int64)
    flat = lm.initial(SMALL) * 5
    texts = [None, "", " \n", "one", "One two THREE four five six " * 40, "é\x85x ü", "one more " * 300000]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "one", 1.0), (3, "one", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for s in (SMALL, replace(SMALL, block=3), replace(SMALL, distinct=1)):
        blocks = lm.cut(df, s)
        got = sorted(lm.score(blocks, (vocab, flat), s).collect(), key=str)
        assert len(got) == len(rows)
        by = {r["id"]: r for r in got}
        for i, t in enumerate(texts[:-1]):
            n, total = plain_score(t, vocab.tolist(), flat, SMALL)
            assert by[i]["n_tokens"] == n and by[i]["log_prob"] == pytest.approx(total, abs=2e-3)
            assert by[i]["score"] == (pytest.approx(total / n, abs=1e-4) if n else None)
        assert by[6]["n_tokens"] == 600000 and by[6]["score"] == pytest.approx(
            (plain_score("one more " * 40, vocab.tolist(), flat, SMALL)[1] - plain_score("one more " * 20, vocab.tolist(), flat, SMALL)[1]) / 40, abs=1e-4)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c a", 2.0, "x")], "doc_id long, text string, score double, codes string")
    for part, n in ((df, 1), (df.limit(0), 0), (df.withColumn("text", F.lit(None).cast("string")), 1)):
        blocks = lm.cut(part, SMALL)
        counts = lm.word_counts(blocks)
        model = lm.train(blocks, counts, SMALL)
        assert lm.score(blocks, model, SMALL, counts).count() == lm.score(blocks, model, SMALL).count() == n
        assert len(model[0]) == counts.count()


def test_gradients():
    """A step on one batch moves along the gradient that differences give."""
    rng = np.random.default_rng(3)
    flat = (lm.initial(SMALL) * 3).astype(np.float64)
    tokens, around = rng.integers(0, SMALL.tokens, 40), rng.integers(0, SMALL.tokens + 1, (40, 4))

    def loss(f):
        return -lm.log_probabilities(tokens, around, f, SMALL).mean()
    before, squares = flat.copy(), np.zeros_like(flat)
    lm.train_step(tokens, around, flat, squares, SMALL)
    for i in rng.choice(np.flatnonzero(squares > 1e-8), 30, replace=False):
        step = np.zeros_like(before)
        step[i] = 1e-5
        assert (loss(before + step) - loss(before - step)) / 2e-5 == pytest.approx(math.sqrt(squares[i]) * np.sign(before[i] - flat[i]), rel=1e-3, abs=1e-7)


def test_training_beats_the_start(documents):
    s = lm.Settings(classes=8, shared=8)
    blocks = lm.cut(documents, s)
    counts = lm.word_counts(blocks)
    vocab, flat = lm.train(blocks, counts, s)
    trained, start = (lm.score(blocks, (vocab, net), s).agg(F.sum("log_prob")).first()[0] for net in (flat, lm.initial(s)))
    assert trained > start
    words = Counter(w for r in documents.collect() for w in re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower()))
    plain = Counter({int(np.uint64(lm.xxh64_intdigest(w)).view(np.int64)): n for w, n in words.items()})
    assert {r["word"]: r["n"] for r in counts.collect()} == plain
    assert vocab.tolist() == sorted(plain, key=lambda w: (-plain[w], w))[:s.tokens - s.shared]


def test_codes_survive_packing():
    for codes in ([], [0], [1, 65535, 65536, 1 << 31, 5]):
        assert lm.unpacked(lm.packed(np.array(codes, np.uint32))).tolist() == codes


def plain_mark(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16)


def plain_mix(rows, repeats, entropy, budget, block_docs, seed=mixing.SEED):
    """The contract in plain loops over one list of rows (doc_id, text, source)."""
    dealt, total, docs = [], Counter(), Counter()
    for i, text, source in rows:
        group = ("true" if source is None else f"false:{source}")
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        mark = plain_mark(seed, i, hashlib.md5((text or "").encode()).hexdigest())
        dealt.append((i, source, group, tokens, mark))
        total[group] += tokens
        docs[group] += 1
    everything = sum(total.values())
    q = {g: t / everything for g, t in total.items() if t}

    def meets(x):
        z = sum(v ** x for v in q.values())
        h = -sum(v ** x / z * math.log(v ** x / z) for v in q.values())
        most, least = max(v ** (x - 1) for v in q.values()), min(v ** (x - 1) for v in q.values())
        read = most / least if budget is None else most / z * budget / everything
        return (entropy is None or h <= entropy * math.log(len(q))) and (repeats is None or read <= repeats)
    low, high = 0.0, 1.0
    if meets(0.0):
        high = 0.0
    else:
        for _ in range(mixing.STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(mid) else (mid, high)
    z = sum(v ** high for v in q.values())
    whole = everything * z / min(v ** (high - 1) for v in q.values()) if budget is None else budget
    out = []
    for group in total:
        weight = q[group] ** high / z if group in q else 0.0
        reads = round(weight * whole / total[group], 6) if group in q else 1.0
        full, rest = math.floor(reads), round((reads - math.floor(reads)) * total[group])
        blocks = math.ceil(docs[group] / block_docs)
        supers = math.ceil(math.sqrt(blocks))
        by = defaultdict(list)
        for d in dealt:
            if d[2] == group:
                by[d[4] % blocks].append(d)
        for epoch in range(full + (rest > 0)):
            begin = 0
            turns = {b: plain_mark(seed, epoch, group, b) for b in by}
            for b in sorted(by, key=lambda b: (turns[b] * supers >> 32, turns[b], b)):
                for i, source, _, tokens, mark in sorted(by[b], key=lambda d: (plain_mark(seed, epoch, d[4]), d[4], d[3])):
                    if epoch < full or begin + tokens <= rest:
                        at = min((epoch * total[group] + begin) / max(reads * total[group], 1), 1)
                        out.append((i, source, epoch, b, tokens, at, weight))
                    begin += tokens
    return out


@pytest.mark.parametrize("repeats,entropy,budget", [(2.0, None, None), (None, 0.9, None), (4.0, None, 3000), (1.5, 0.95, 20000), (None, None, 500)])
def test_mixing(spark, repeats, entropy, budget):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice(["hot"] * 8 + ["b", "c", None])) for i in range(200)]
    rows += [(500, None, "empty"), (501, "", "empty"), (502, "", "b"), (None, "a b c", "c"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, tokens string")
    got = mixing.mix(df, repeats=repeats, entropy=entropy, budget=budget, block_docs=16).collect()
    want = plain_mix(rows, repeats, entropy, budget, 16)

    got, want = (sorted(map(tuple, rows), key=lambda r: (str(r[:5]), r[5])) for rows in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=2e-6)
    if budget is None:
        assert Counter(r[0] for r in got).keys() == Counter(r[0] for r in rows).keys()
    assert mixing.mix(df.limit(0)).count() == 0
