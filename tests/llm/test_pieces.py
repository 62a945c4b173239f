"""Encoding and decoding against the library itself: ids, spans, texts, and the character map of a public rule set."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from evispark.llm import pieces, sequence_queries

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "Hello", "  Hello   wörld ½ ﬁ \t x\n\ny 你好😀 ", "a▁b ▁▁c", "▁", " ▁x", "\t lead", "\x00 zero \x00", "<s> </s> <unk> <0x0A>",
         "1234567 12.5%", "ｆｕｌｌ　ｗｉｄｔｈ", "é   nbsp em", "क्षि ไทย العربية", "x" * 3000, " " * 700 + "end" + " " * 40, "👩‍👩‍👧‍👦 flag 🇫🇷", "​​", "ﷺ ㍿ ①"]


def random_texts(n=300, seed=4):
    rng = random.Random(seed)
    alphabet = list("abcdefghij      \n\t▁éß½ﬁǺ　你😀0123.,-<>'_;!") + ["the ", "ing", "  ", "tion"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def altered(**spec):
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(FILE, "rb").read())
    fallback = spec.pop("byte_fallback", None)
    if fallback is not None:
        proto.trainer_spec.byte_fallback = fallback
        kept = [p for p in proto.pieces if p.type != pieces.BYTE]
        del proto.pieces[:]
        proto.pieces.extend(kept)
    for name, value in spec.items():
        setattr(proto.normalizer_spec, name, value)
    return proto.SerializeToString()


def nmt_nfkc():
    spec = sentencepiece_model_pb2.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    assert len(spec.precompiled_charsmap) > 100_000
    return spec.precompiled_charsmap


VARIANTS = {"as it is": {}, "character map": {"precompiled_charsmap": True}, "character map, stripped": {"precompiled_charsmap": True, "remove_extra_whitespaces": True},
            "stripped": {"remove_extra_whitespaces": True}, "no prefix": {"add_dummy_prefix": False}, "no bytes": {"byte_fallback": False}}


@pytest.mark.parametrize("name", VARIANTS)
def test_against_the_library(name):
    spec = dict(VARIANTS[name])
    if spec.get("precompiled_charsmap"):
        spec["precompiled_charsmap"] = nmt_nfkc()
    blob = altered(**spec)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=blob)
    ours = pieces.Model(blob)
    for text in TEXTS + random_texts():
        ids, begins, ends = (x.tolist() for x in ours.encode(text))
        want = theirs.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in want], text
        assert list(zip(begins, ends)) == [(p.begin, p.end) for p in want], text
        assert ours.decode(ids + [ours.end]) == theirs.decode(ids + [ours.end]), text


def test_fast_way_is_the_general_way():
    model = pieces.Model(open(FILE, "rb").read())
    for text in TEXTS + random_texts(seed=8):
        if pieces.SPACE in text or not text:
            continue
        fast = [x.tolist() for x in model.encode(text)]
        form, align = model.normal(text)
        edges = np.append(0, np.cumsum(np.frombuffer(b"".join(model.merged(s)[1] for s in model.segment.findall(form)), np.int32)))
        assert fast[1] == align[edges[:-1]].tolist() and fast[2] == align[edges[1:]].tolist()


def test_decode_any_ids():
    model, theirs = pieces.Model(open(FILE, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(6)
    marks = [0, 1, 2, 28705, 259] + list(range(3, 259, 7))
    for _ in range(2000):
        ids = [rng.choice(marks) if rng.random() < .7 else rng.randrange(32000) for _ in range(rng.randrange(0, 9))]
        assert model.decode(ids) == theirs.decode(ids), ids


def test_lists_and_heaps_agree():
    model = pieces.Model(open(FILE, "rb").read())
    for text in random_texts(400, 12):
        assert model._short(list(text)) == model._long(list(text))
        assert "".join(model.segment.findall(text)) == text


def test_unsuitable_models():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(FILE, "rb").read())
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.Model(proto.SerializeToString())


def test_frames(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rows = [(None, None, 1)] + [(i % 40, t, 2) for i, t in enumerate(TEXTS + random_texts(60))] + [(7, "long words " * 60_000, 3)]
    docs = spark.createDataFrame(rows, "key long, body string, ids int")
    out = pieces.encode(docs, FILE, "key", "body", decoded=True)
    got = sorted((str(r["id"]), tuple(r["ids"]), tuple(r["begins"])) for r in out.collect())
    want = []
    for key, text, _ in rows:
        p = theirs.encode(text or "", return_type="proto").pieces
        want.append((str(key), tuple(x.id for x in p) + (2,), tuple(x.begin for x in p) + (len((text or "").encode()),)))
    assert got == sorted(want)
    decode = pieces.decoder(FILE)
    assert sorted(r[0] for r in out.select(decode(out["ids"])).collect()) == sorted((t or "").replace(pieces.SPACE, " ") for _, t, _ in rows)
    assert sorted(r["decoded"] for r in out.collect()) == sorted((t or "").replace(pieces.SPACE, " ") for _, t, _ in rows)
    assert [list(r["ids"]) for r in pieces.encode(docs.where("key is null"), FILE, "key", "body", end=False).collect()] == [[]]
    assert pieces.encode(docs.limit(0), FILE, "key", "body").collect() == []


def test_query(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=FILE)
    got = {r["doc_id"]: r for r in sequence_queries.op13_pieces(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode(d["text"] or "", add_eos=True)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
