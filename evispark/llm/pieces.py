"""SentencePiece BPE encoding that keeps offsets, and decoding.

Normalisation takes, at every place of a text, the longest prefix that the model's compiled character map holds, and
notes for each byte of the normal form where in the text it came from.  Pieces are merged inside segments that begin with a
run of space marks, or with a sign that no piece has behind a letter: no piece of the model reaches over such a border, so
merges never leave a segment, and a segment met again is remembered.  A piece's span of bytes follows from the alignment.
"""

from __future__ import annotations

import re
import string
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the model format: the space mark and the kinds of pieces.
SPACE, REPLACED = "▁", "�"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Segments up to so many characters are merged in a list and remembered, at most so many of them at once.
SHORT, REMEMBERED = 32, 1 << 18


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 bytes, and the normal forms, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.forms = blob[4 + size:]
        self.starts: dict[str, bool] = {}

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at this place, and its normal form."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, form = found
        return length, self.forms[form:self.forms.index(b"\0", form)]

    def begins(self, char: str) -> bool:
        """Whether any key can begin with this character (remembered)."""
        known = self.starts.get(char)
        if known is None:
            node, known = self._child(self.units[0]) if self.units else 0, bool(self.units)
            for byte in char.encode("utf-8", "surrogatepass") if self.units else b"":
                node ^= byte
                unit = self.units[node] if node < len(self.units) else 0
                if unit & 0x800000FF != byte:
                    known = False
                    break
                node ^= self._child(unit)
            self.starts[char] = known
        return known


class Model:
    """A BPE model with its normalisation, read from the bytes of a model file.

    Models of another type, with user-defined or unused pieces, with pieces that go on behind an inner space mark, or with
    the space mark as suffix are errors: their pieces follow other rules.
    """

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto.FromString(blob)
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trained.model_type != BPE or kinds & {USER_DEFINED, UNUSED} or trained.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("only BPE models of normal pieces with the space mark in front")
        if any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == NORMAL):
            raise ValueError("pieces must not go on behind an inner space mark")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.strip = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces, self.kinds = [p.piece for p in proto.pieces], [p.type for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.fallback = [self.ids[f"<0x{b:02X}>"] for b in range(256)] if trained.byte_fallback else None
        self.end = self.ids.get(trained.eos_piece or "</s>", -1)
        self.shown = [{CONTROL: "", UNKNOWN: trained.unk_surface}.get(k, p.replace(SPACE, " ")) for p, k in zip(self.pieces, self.kinds)]
        self.bytes = {i: int(p[1:-1], 16) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.numbers = {m: {p: (struct.pack("=i", self.ids[p]), struct.pack("=i", len(p.encode()) - (len(SPACE.encode()) - m) * p.count(SPACE)))
                            for p in self.scores} for m in (1, len(SPACE.encode()))}
        self.lowest = min(self.scores.values(), default=0.0) - 1
        self.known: dict[int, dict[str, tuple[bytes, bytes]]] = {1: {}, len(SPACE.encode()): {}}
        # Signs that no piece has behind a letter begin a segment there, as space marks do everywhere: no merge crosses.
        after = {p[k + 1] for p in self.scores for k in range(len(p) - 1) if p[k].isalpha()}
        signs = re.escape("".join(c for c in string.punctuation + "\n" if c not in after))
        self.segment = re.compile(f"{SPACE}*[^{SPACE}][^{SPACE}{signs}]*(?:(?<![^\\W\\d_])[{signs}][^{SPACE}{signs}]*)*|{SPACE}+")

    # -- normal form ---------------------------------------------------------------------------------------------------

    def normal(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form with space marks, and for each of its bytes, and its end, the byte of the text it came from."""
        data, mark = text.encode("utf-8", "surrogatepass"), SPACE.encode()
        forms, origins = [], []                  # normal forms in order, and where each began
        spaced = self.strip
        for begin, form in self._forms(text, data):
            if spaced:                           # of a run of spaces the first stays, at the beginning none
                form = form.lstrip(b" ")
            if form:
                forms.append(form.replace(b" ", mark))
                origins.append(begin)
                spaced = self.strip and form.endswith(b" ")
        if not forms:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            forms, origins = [mark, *forms], [origins[0], *origins]
        whole = b"".join(forms)
        align = np.append(np.repeat(np.array(origins, np.int64), [len(f) for f in forms]), len(data))
        while self.strip and whole.endswith(mark):
            whole = whole[:-len(mark)]
        return whole.decode("utf-8", "surrogatepass"), align[:len(whole) + 1]

    def _forms(self, text: str, data: bytes) -> Iterator[tuple[int, bytes]]:
        """Begin and normal form of each stretch of the text, in order."""
        at = until = 0
        for char in text:
            size = len(char.encode("utf-8", "surrogatepass"))
            if at >= until:                       # not inside a key that was taken already
                met = self.map.longest(data, at) if self.map.begins(char) else None
                until = at + (met[0] if met else size)
                yield at, met[1] if met else data[at:until]
            at += size

    # -- pieces --------------------------------------------------------------------------------------------------------

    def merged(self, segment: str, mark: int = len(SPACE.encode())) -> tuple[bytes, bytes]:
        """Ids of a segment's pieces, and how many bytes each covers if a space mark has ``mark`` bytes; both as 32-bit numbers."""
        known = self.known[mark].get(segment)
        if known is not None:
            return known
        parts = self._short(list(segment)) if len(segment) <= SHORT else self._long(list(segment))
        numbers = self.numbers[mark]
        found = [numbers.get(p) or self._foreign(p, mark) for p in parts]
        joined = b"".join([f[0] for f in found]), b"".join([f[1] for f in found])
        if len(segment) <= SHORT:
            if len(self.known[mark]) >= REMEMBERED:
                self.known[mark].clear()
            self.known[mark][segment] = joined
        return joined

    def _foreign(self, char: str, mark: int) -> tuple[bytes, bytes]:
        """A character of no piece: its bytes, of which the last covers it, or one unknown id."""
        data = char.encode("utf-8", "surrogatepass")
        size = mark if char == SPACE else len(data)
        ids, sizes = ([self.fallback[b] for b in data], [0] * (len(data) - 1) + [size]) if self.fallback else ([self.unknown], [size])
        return array("i", ids).tobytes(), array("i", sizes).tobytes()

    def _short(self, parts: list[str]) -> list[str]:
        """Merges of few characters: the scores of all neighbours stand in a list, the best goes first, the leftmost of equals."""
        get, none = self.scores.get, self.lowest
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            k = pairs.index(best)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def _long(self, chars: list[str]) -> list[str]:
        """The same by a heap, in n log n steps."""
        scores, heap, n = self.scores, [], len(chars)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(left: int, right: int) -> None:
            both = chars[left] + chars[right]
            score = scores.get(both)
            if score is not None:
                heappush(heap, (-score, left, right, both))
        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, both = heappop(heap)
            if not chars[left] or not chars[right] or chars[left] + chars[right] != both:
                continue
            chars[left], chars[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
                offer(left, after[right])
            if before[left] >= 0:
                offer(before[left], left)
        return [c for c in chars if c]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and per id the first byte and the end of its span in the text; without control ids."""
        plain = not self.map.units and not self.strip and SPACE not in text
        if plain:                                 # only spaces change, each into one mark: spans are sizes, added up
            form, align = (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        else:
            form, align = self.normal(text)
        if not text or not form:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        mark = 1 if plain else len(SPACE.encode())
        known, merged = self.known[mark].get, self.merged
        found = [known(s) or merged(s, mark) for s in self.segment.findall(form)]
        ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        edges = np.append(0, np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), np.int32), dtype=np.int64))
        # In the plain case a mark stands for one space, the added one for nothing.
        edges = np.maximum(edges - self.prefix, 0) if plain else align[edges]
        if self.fallback is None and len(ids):    # neighbouring unknown pieces are one
            keep = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
            return ids[keep], edges[:-1][keep].astype(np.int32), np.append(edges[:-1][keep][1:], edges[-1]).astype(np.int32)
        return ids, edges[:-1].astype(np.int32), edges[1:].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: byte pieces as UTF-8, where that is invalid a replacement each; one leading space goes."""
        shown, out = self.shown, []
        if self.bytes.keys().isdisjoint(ids):
            out = [shown[i] for i in ids]
        else:
            held = bytearray()
            for i in ids:
                if i in self.bytes:
                    held.append(self.bytes[i])
                    continue
                if held:
                    out.append(_valid(held))
                    held.clear()
                out.append(shown[i])
            out.append(_valid(held))
        if self.prefix or self.strip:             # the space that encoding put in front goes
            for k, i in enumerate(ids):
                if self.kinds[i] not in (NORMAL, CONTROL):
                    break
                spaced = shown[i].startswith(" ")
                if spaced:
                    out[k] = shown[i][1:]
                if out[k] or spaced and not self.strip:
                    break
        return "".join(out)


def _valid(data: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes a replacement."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACED)
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", end: bool = True,
           decoded: bool = False) -> DataFrame:
    """Per document ``id``, ``ids``, ``begins`` and ``ends`` (bytes of the text that each piece covers, end exclusive); with
    ``decoded`` also the text that the ids give back.

    ``model_file`` is a path that the driver can read; the model (half a megabyte, a fixed size) goes to the tasks with the
    function.  With ``end`` the model's end id follows, over no bytes.  A character of no piece becomes its bytes, of which the last
    covers it.  A null text counts as empty: the end id alone, or nothing.  Ids may be null or occur again; an empty table
    gives no rows; other columns are not read.  Texts of any length are encoded whole, a segment without spaces in n log n steps.
    """
    with open(model_file, "rb") as f:
        blob = f.read()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(blob)
        last = [np.array([model.end], np.int32)] if end else []
        for batch in batches:
            for part in _slices(batch):
                ids, begins, ends, sizes, back = [], [], [], [0], []
                for text in part.column("text").to_pylist():
                    a, b, e = model.encode(text or "")
                    over = [np.array([len((text or "").encode("utf-8", "surrogatepass"))], np.int32)] if end else []
                    ids += [a, *last]
                    begins += [b, *over]
                    ends += [e, *over]
                    sizes.append(len(a) + len(last))
                    if decoded:
                        back.append(model.decode(a.tolist() + [model.end] * end))
                offsets = pa.array(np.cumsum(sizes).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists, *([pa.array(back, pa.string())] if decoded else [])],
                                                 ["id", "ids", "begins", "ends", *["decoded"] * decoded])

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *(T.StructField(c, numbers) for c in ("ids", "begins", "ends")),
                           *[T.StructField("decoded", T.StringType())] * decoded])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(work, schema)


def _slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text; one text is never cut."""
    lengths = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def decoder(model_file: str):
    """A column function from an array of ids to their text; null stays null."""
    with open(model_file, "rb") as f:
        blob = f.read()

    @F.pandas_udf(T.StringType())
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(blob)
        for ids in parts:
            yield pd.Series([None if i is None else model.decode(i.tolist()) for i in ids], index=ids.index, dtype=object)

    def of(ids: Column) -> Column:
        return decode(ids)
    return of
