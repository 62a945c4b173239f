"""SimHash, contamination, embeddings and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from evispark.llm import common, decontaminate, embeddings, simhash


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)] + [
        (rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)] + [(-7, -9), (-9, -7)]
    want = Union()
    for a, b in edges:
        if a != b:
            want.link(a, b)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in list(want)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


WORDS = "a b c d É ü 𝒳 the of Is-no x\x85y z\xa0w".split(" ")


def texts(n, seed=1):
    rng = random.Random(seed)
    out = [None, "", " \t", "One", "one two", "ONE\x0btwo\x1cthree four"]
    for _ in range(n):
        ws = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 80))]
        out.append(" ".join(ws))
        for _ in range(rng.randrange(3)):
            ws = list(ws)
            ws[rng.randrange(len(ws))] = "q"
            out.append(" ".join(ws))
    return out


def test_fingerprints(monkeypatch):
    for block in (1 << 20, 7):
        monkeypatch.setattr(common, "BLOCK_BYTES", block)
        for t in texts(30):
            assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_golay_keys_meet():
    """Every pair of words within three bits shares a key, in both directions."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 300, np.uint64)
    tables = simhash.golay_tables()
    assert (tables[0] >= 0).all()
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    asking, _ = simhash.golay_keys(a, tables)
    _, answering = simhash.golay_keys(b, tables)
    assert all(set(x) & set(y) for x, y in zip(asking.tolist(), answering))


@pytest.mark.parametrize("hot", [2048, 1])
def test_near_duplicates(spark, hot):
    rows = [(i, t) for i, t in enumerate(texts(120, seed=hot))]
    rows += [(None, rows[8][1]), (None, "only one without an id"), (4, rows[9][1]), (9, rows[9][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Union()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                want.link(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[want.find(i)] = min(doc, least.get(want.find(i), doc))
    got = sorted(str((r["id"], r["fp"] % (1 << 64), r["component"])) for r in simhash.find_near_duplicates(df, hot=hot).collect())
    assert got == sorted(str((doc, prints[i], least.get(want.find(i)))) for i, (doc, _) in enumerate(rows))
    assert len(set(least.values())) < len(set(prints))
    assert simhash.find_near_duplicates(df.limit(0)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items):
    out = []
    for doc, text, *_ in docs:
        ws, hit, ids = plain_words(text), set(), set()
        for item, item_text in items:
            iw = plain_words(item_text)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[s:s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item)} if item is not None else set()
        out.append(str((doc, len(ws), sorted(hit), sorted(ids))))
    return sorted(out)


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "É", "über", "no"] + [f"w{i}" for i in range(12)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    items = [(1, " ".join(base[:25])), (10, " ".join(base[10:30])), (2, "short one!"), (3, "w1"), (4, ""), (5, None), (None, " ".join(base[40:55])),
             (1, " ".join(base[:25])), (7, "the the the the the the the the the the the the"), (8, " ".join(base[20:29]))]
    docs = [(i, t, "x", "y") for i, t in enumerate([
        None, "", " . ", " ".join(base), " ".join(base).upper(), "x " + " ".join(base[5:14]), "x " + " ".join(base[5:15]) + " y", "a short ONE.",
        "the " * 40, " ".join(base[40:55]), " ".join(rng.choice(vocabulary) for _ in range(400)), "Short-one w1 w1", "É" + " ".join(base[:12])])]
    docs += [docs[3], (None, docs[3][1], "x", "y"), (3, "other", "x", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(df, bench)
    got = sorted(str((r["id"], r["n_words"], r["hit_positions"], r["items"])) for r in found.collect())
    assert got == plain_contamination(docs, items)
    assert all(r["n_hit"] == len(r["hit_positions"]) for r in found.collect())
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_texts_are_cut_into_words_once(spark):
    """The number of words comes from the rows of the shingles, for every row of a document and also where nothing is met."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, "x"), (None, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "b C")], "item_id string, text string")
    found = decontaminate.find_contamination(docs, items)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"] or 0, r["n_words"], r["n_hit"]) for r in found.collect()) == [(0, 2, 2), (1, 3, 2), (1, 3, 2), (2, 0, 0), (3, 1, 0)]
    none = decontaminate.find_contamination(docs, items.limit(0))
    assert sorted((r["id"] or 0, r["n_words"], r["n_hit"]) for r in none.collect()) == [(0, 2, 0), (1, 3, 0), (1, 3, 0), (2, 0, 0), (3, 1, 0)]


def test_contamination_of_shuffled_sides(spark, monkeypatch):
    """The plan without broadcasts gives the same rows."""
    docs = spark.createDataFrame([(i, f"w{i % 3} " + " ".join(f"b{j}" for j in range(i % 20))) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(12)))], "item_id long, text string")
    want = sorted(map(str, decontaminate.find_contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "is_small", lambda *a: False)
    monkeypatch.setattr(decontaminate, "fits", lambda *a: False)
    assert sorted(map(str, decontaminate.find_contamination(docs, bench).collect())) == want


def plain_links(vectors, threshold=0.9):
    units = {}
    for i, (_, v) in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            units[i] = v / np.linalg.norm(v)
    links = {(i, j) for i in units for j in units if i != j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold}
    return links


def near_vectors(rng, groups, members, size, noise):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(size)
        out += [(centre + rng.standard_normal(size) * noise * np.linalg.norm(centre) / np.sqrt(size)).tolist() for _ in range(members)]
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    vectors = near_vectors(rng, 30, 5, 64, 0.12) + rng.standard_normal((150, 64)).tolist() + near_vectors(rng, 1, 40, 64, 0.08)
    rows = list(enumerate(vectors))
    rows += [(900, vectors[0]), (901, vectors[0]), (902, None), (903, []), (904, [0.0] * 64), (905, [float("nan")] * 64), (906, [float("inf")] + [1.0] * 63),
             (907, [None] + [1.0] * 63), (None, vectors[0]), (908, (np.array(vectors[3]) * 1e30).tolist()), (909, [1.0, 2.0]), (910, [2.0, 4.1]),
             (0, vectors[0])]
    links = plain_links([(None, None) if i is None else (i, v) for i, v in rows])
    want = Union()
    first = {}
    for k, (i, _) in enumerate(rows):
        want.find(k)
        if i is not None and rows[k][1] and not (i >= 902 and i <= 907):
            want.link(k, first.setdefault(i, k))
    for a, b in links:
        want.link(a, b)
    expected = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if want.find(m) == want.find(k) and rows[m][0] is not None]
        expected.append(str((i, sum(a == k for a, _ in links), min(ids) if ids else None)))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, size int")
    settings = embeddings.Settings(block=block)
    got = [str((r["id"], r["n_links"], r["component"])) for r in embeddings.find_near_duplicates(df, settings=settings).collect()]
    assert sorted(got) == sorted(expected)
    assert embeddings.find_near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at a cosine of just over 0.9, the hardest there are: at least nine in ten are found, and none below."""
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(600):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = rng.uniform(0.9, 0.93)
        vectors += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist()]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in embeddings.find_near_duplicates(df).collect())
    want = len(plain_links(rows))
    assert 0.9 * want <= found <= want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    settings = embeddings.Settings()
    units = embeddings.unit(rng.standard_normal((400, 64)))
    turn = embeddings.rotation(64, settings)
    turned, signs, factor = embeddings.encode(units, turn)
    estimate = (signs @ turned.T) / (np.sqrt(turned.shape[1]) * factor[:, None])
    off = ~np.eye(400, dtype=bool)
    error = (estimate - units @ units.T)[off]
    assert abs(error.mean()) < 2e-3
    bound = settings.confidence * np.sqrt((1 - factor ** 2) / factor ** 2 / (settings.bits - 1))
    assert (np.abs(estimate - units @ units.T) <= bound[:, None])[off].mean() > 0.999


def test_stored_codes_leave_few_pairs():
    """Bounds by counted bits hold, and few pairs far below the threshold are left to compute exactly."""
    rng = np.random.default_rng(3)
    settings = embeddings.Settings()
    units = rng.standard_normal((500, 96))
    units[250:] = units[:250] + rng.standard_normal((250, 96)) * 0.3
    units = embeddings.unit(units)
    turned, signs, factor = embeddings.encode(units, embeddings.rotation(96, settings))
    words, low, step = embeddings.pack(turned, signs, settings)
    codes = embeddings.Codes(256, words, factor, low, step)
    x, y = map(np.ravel, np.meshgrid(np.arange(500), np.arange(500)))
    exact = (units @ units.T)[x, y]
    upper = codes.upper(x, y, settings)
    assert (upper >= exact)[x != y].mean() > 0.999
    bound = np.hypot(embeddings.errors(factor, 256, settings)[x], settings.confidence * step[y] / 2 / factor[x])
    assert abs((upper - bound - exact)[x != y].mean()) < 2e-3
    for groups in (np.array([0, 500]), np.arange(0, 501, 50)):
        a, b = embeddings._candidates(groups, codes, settings)
        got, within = set(zip(a.tolist(), b.tolist())), np.searchsorted(groups, np.arange(500), side="right")
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(units @ units.T >= 0.9, 1))) if within[i] == within[j]}
        assert want <= got and len(got) <= len(want) + 25
