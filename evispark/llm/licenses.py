"""Licence scan: a positional index of rare licence words, met by relative position and verified by key phrases."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGREE = 0.6
VOTES = 2

# Phrases whose every place is reported.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, template text, and the phrases of it that a match must hold.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", ["permission is hereby granted", "free of charge"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("mit-release", "released under the mit license", ["mit license"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify", "with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
# The words of a text before A-Z are lower-cased; the same ones after.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = {upper: upper + 32 for upper in range(65, 91)}

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("templates", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])))])


@dataclass(frozen=True)
class Template:
    """``need``: words that must stand in place; ``votes``: those of its rarest words that then must."""
    label: str
    words: list[str]
    keys: list[list[str]]
    need: int
    votes: int


@dataclass(frozen=True)
class Index:
    """``postings``: rare word -> (template, place); ``phrases``: a phrase's rarest word -> (label, place, words)."""
    templates: list[Template]
    postings: dict[str, list[tuple[int, int]]]
    phrases: dict[str, list[tuple[str, int, list[str]]]]


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> list[str]:
    """All words of the templates and phrases: a parameter's size, not the corpus's."""
    texts = [t for _, t, _ in templates] + list(phrases)
    return sorted({w for t in texts for w in t.split()})


def word_counts(docs: DataFrame, terms: Iterable[str], text_column: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of all of them each term stands."""
    terms = list(terms)
    known = re.compile(WORD)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, found, total = set(terms), dict.fromkeys(terms, 0), 0
        for batch in batches:
            total += len(batch)
            for text in batch["text"]:
                if text:
                    for w in wanted.intersection(w.translate(_LOWER) if w.isascii() else w for w in set(known.findall(text))):
                        found[w] += 1
        yield pd.DataFrame({"word": [*terms, None], "n": [*found.values(), total]})

    rows = docs.select(F.col(text_column).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in rows.collect()}   # one row per term
    return counts.pop(None, 0), counts


def needed(length: int, agree: float = AGREE) -> int:
    return math.ceil(agree * length - 1e-9)


def build_index(total: int, counts: dict[str, int], templates=TEMPLATES, phrases=PHRASES, agree: float = AGREE) -> Index:
    """Postings of each template's words of highest IDF, and each phrase under its rarest word.

    A match has ``need`` words in place, so it misses at most ``n - need``: of the ``n - need + votes`` rarest, at least ``votes``
    stand in place.  Only those are looked up, and nothing is lost.
    """
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary(templates, phrases)}
    order = {w: rank for rank, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
    kept, postings, anchored = [], {}, {}
    for t, (label, text, keys) in enumerate(templates):
        ws = text.split()
        need = needed(len(ws), agree)
        votes = min(VOTES, need)
        for place in sorted(range(len(ws)), key=lambda i: (order[ws[i]], i))[:len(ws) - need + votes]:
            postings.setdefault(ws[place], []).append((t, place))
        kept.append(Template(label, ws, [k.split() for k in keys], need, votes))
    for phrase, label in phrases.items():
        ws = phrase.split()
        place = min(range(len(ws)), key=lambda i: order[ws[i]])
        anchored.setdefault(ws[place], []).append((label, place, ws))
    return Index(kept, postings, anchored)


def _stands(ws: list[str], at: int, phrase: list[str]) -> bool:
    return at >= 0 and ws[at:at + len(phrase)] == phrase


def scan(text: str | None, index: Index) -> dict:
    """What one text holds: number of words, places of phrases (start, label), and templates with their share of words in place.

    The text's rare licence words propose alignments (place in the text less place in the template); those that enough words
    have in common are looked at: enough words must be in place, and each key phrase must stand in full where
    the alignment puts it.
    """
    ws = re.findall(WORD, text) if text else []
    n = len(ws)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(ws):
        if w.isascii():
            w = ws[i] = w.lower()
        else:
            w = ws[i] = w.translate(_LOWER)
        if w in index.postings or w in index.phrases:
            at.setdefault(w, []).append(i)
    places = sorted((p - place, label) for w in index.phrases if w in at for p in at[w]
                    for label, place, phrase in index.phrases[w] if _stands(ws, p - place, phrase))
    votes: dict[tuple[int, int], int] = {}
    for w, found in at.items():
        for t, place in index.postings.get(w, ()):
            for p in found:
                votes[t, p - place] = votes.get((t, p - place), 0) + 1
    labels: dict[str, float] = {}
    for (t, begin), met in votes.items():
        template = index.templates[t]
        if met < template.votes:
            continue
        words = template.words
        standing = sum(0 <= begin + i < n and ws[begin + i] == w for i, w in enumerate(words))
        if standing >= template.need and all(any(_stands(ws, begin + i, k) for i in range(len(words)) if words[i:i + len(k)] == k)
                                             for k in template.keys):
            labels[template.label] = max(labels.get(template.label, 0.0), standing / len(words))
    return {"n_words": n, "places": [{"start": s, "label": x} for s, x in places],
            "templates": [{"label": x, "share": s} for x, s in sorted(labels.items())]}


def find_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, phrases=PHRASES,
                  agree: float = AGREE) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``places`` array<struct<start, label>> of all phrases in order,
    ``templates`` array<struct<label, share>> of templates met, with their share of words in place.

    IDF comes from all documents: one pass counts the licence words, whose number the templates bound; the
    index is as small as the templates and goes along with the tasks.  Every place of every phrase is found: a place
    holds the phrase's rarest word; and every alignment of every template with ``agree`` of its words in place.

    Null and empty texts have no words; repeated rows and null ids are judged each on their own; an empty
    table gives an empty one.  Other columns are not read.
    """
    index = build_index(*word_counts(docs, vocabulary(templates, phrases), text_column), templates, phrases, agree)

    @F.pandas_udf(RESULT)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([scan(t, index) for t in batch], columns=["n_words", "places", "templates"])

    return docs.select(F.col(id_column).alias("id"), found(F.col(text_column)).alias("f")).select(
        "id", "f.n_words", "f.places", "f.templates")
