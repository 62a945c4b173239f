"""Runs of words against a plain search of all periods; the registered query against the contract, rule by rule."""

import hashlib
import random
import re
import zlib

import numpy as np

from evispark.llm import periodic, sequence_queries

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def hard_texts(seed=5):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, ["a", "b"] * 40 + ["c"] + ["a", "b"] * 40, ["x"] * 5 + ["y"] * 20 + ["x"] * 13]
    for _ in range(150):
        words = []
        while len(words) < rng.randrange(1, 300):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
            words += (unit * rng.randrange(1, 8))[:rng.randrange(1, 90)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))]
        out.append(words)
    return out


def test_cover_meets_everywhere():
    assert sorted((a - b) % 31 for a in periodic.COVER for b in periodic.COVER if a != b) == list(range(1, 31))
    assert (periodic._meeting() >= 0).all()


def test_extensions():
    rng = np.random.default_rng(2)
    for codes in (rng.integers(0, 2, 400), np.zeros(300, np.int64), np.arange(90), np.tile(rng.integers(0, 3, 70), 6), np.zeros(1, np.int64)):
        ext = periodic.Extensions(codes.astype(np.int64))
        n = len(codes)
        x, y = rng.integers(0, n + 1, 3000), rng.integers(0, n + 1, 3000)
        x, y = x[x != y], y[x != y]
        want = []
        for a, b in zip(x.tolist(), y.tolist()):
            far = 0
            while max(a, b) + far < n and codes[a + far] == codes[b + far]:
                far += 1
            want.append(far)
        assert ext.common(x, y).tolist() == want


def test_runs():
    texts = hard_texts()
    numbers = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
    want = [plain_runs(t) for t in texts]
    assert [[tuple(map(int, r)) for r in rows] for rows in periodic.runs(coded)] == want
    assert [[tuple(map(int, r)) for r in periodic.runs([c])[0]] for c in coded] == want
    assert sum(map(len, want)) > 100


def test_places_in_small_batches(monkeypatch):
    texts = hard_texts(9)
    numbers = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
    monkeypatch.setattr(periodic, "BATCH_PLACES", 50)
    assert [[tuple(map(int, r)) for r in rows] for rows in periodic.runs(coded)] == [plain_runs(t) for t in texts]


def test_find_runs(spark):
    texts = [None, "", " \t\n", "é " * 30, "one\x0btwo\x1cthree\x85 " * 9] + [" ".join(t) for t in hard_texts(7)] + ["lo la " * 40_000 + "end"]
    rows = [(i if i else None, t, 1, "c") for i, t in enumerate(texts)] + [(3, texts[3], 2, "d")]
    docs = spark.createDataFrame(rows, "key long, body string, runs int, id string").repartition(3)
    got = {}
    for r in periodic.find_runs(docs, "key", "body").collect():
        assert r["id"] not in got or got[r["id"]] == r
        got[r["id"]] = r
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(words) if len(words) < 10_000 else [(0, 80_000, 2)]
        r = got[i if i else None]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == found
        if len(words) < 10_000:
            assert r["collapsed"] == collapsed(words, found)
    assert got[len(texts) - 1]["collapsed"] == "lo la end"
    assert periodic.find_runs(docs.limit(0), "key", "body").collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r.asDict() for r in sequence_queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    runs_met = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue   # the plain search is quadratic
        found = plain_runs(words)
        runs_met += len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        assert got[d["doc_id"]] == {
            "doc_id": d["doc_id"], "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{ln},{q}\n" for s, ln, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(collapsed(words, found).encode()).hexdigest()}
    assert runs_met > 10
