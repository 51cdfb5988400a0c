"""Packing along a space-filling curve: like documents share training sequences, and little is padding.

A document's token ids are hashed to signs in a few dimensions; the sum of them over the root of their number is its
place, and the Hilbert index of that place its key. Keys are cut into ranges at quantiles of a size-weighted sample, documents travel once (as token ids) to
their range, are sorted by key there, and are laid end to end into sequences. Only the last sequence of a range can be
short. Documents with one key, such as copies, are told apart by a hash of their id and their place in the input, so that
a range stays bounded whatever rows repeat, rows of one id or without any among them.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import tokenizer
from plumbline.llm.shared import text_or_empty

DIMS, BITS = 3, 10  # of the curve: 30-bit keys
SAMPLE_DOCS, PER_RANGE = 4_000, 4  # documents whose keys place the range boundaries: about so many, or so many a range
RANGE_BYTES = 4_000_000  # of text in a range, about
MAX_RANGES = 100_000  # beyond 400 GB of text ranges grow; they are streamed, not held, so that this bounds the sample alone
FIELD = 21  # bits of a count of signs; three fit a 64-bit number
MARK = "\x01"  # between the words of a text that has none
CACHE_WORDS = 1_000_000  # remembered words of a Python worker, at most: about 150 MB


def hilbert_index(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve index of integer points (n x dims, coordinates below 2**bits), by exchange and inversion of axes
    from the highest bit down and a Gray decode."""
    x = places.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(totals: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of documents from the sums of their ids' signs: each coordinate is spread over the axis."""
    z = totals / np.sqrt(np.maximum(ids, 1))[:, None]
    at = np.clip(((np.tanh(z * 0.3) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_index(at)


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary shows bytes: printable ones as themselves, the others as the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """A worker's memory of words and their ids as bytes. A word is what stands between single blanks or line breaks that
    have no other white space beside them, with its blank in front: no pre-token of a byte-level vocabulary crosses that."""

    _of: dict[str, Words] = {}

    def __init__(self, path: str):
        self.tok, self.at = tokenizer(path), {}
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.other = re.compile(r"[^\S \n]|" + MARK)
        self.uneven, self.cut = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
        # letters, then marks: two pre-tokens for certain, which the model can encode as they are
        self.plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ſ]+)([,.;:!?]*)").fullmatch
        self.shown, self.model, self.code = _byte_letters(), self.tok.model, "H" if self.kind.itemsize == 2 else "I"
        ids = np.arange(1 << 16, dtype=np.uint64)  # a hashed vector of signs for each id; ids beyond repeat
        with np.errstate(over="ignore"):
            bits = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        plus = 1 - ((bits[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
        self.plus = (plus << (FIELD * np.arange(DIMS))).sum(1)  # the positive signs of an id, one in each field of a number

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if self.uneven.search(text) or text[0] == " " or text[-1] == " ":
            parts = self.cut.split(text)
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = []
        for line in text.split("\n"):  # a lone line break is a pre-token of its own
            first, *rest = line.split(" ")
            out += ["\n", first] if first else ["\n"]
            out += [" " + p for p in rest]
        return out[1:]

    def quick(self, text: str) -> bool:
        """Whether a text's white space is single blanks and line breaks, all between words."""
        return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.other.search(text))

    def sums(self, coded: list[bytes]) -> np.ndarray:
        """The sum of the signs of each text's ids."""
        n = np.array([len(c) // self.kind.itemsize for c in coded], np.int64)
        totals = np.zeros((len(coded), DIMS))
        some = np.flatnonzero(n)
        if not len(some):
            return totals
        ids = np.frombuffer(b"".join(coded), self.kind)
        if self.kind.itemsize > 2:
            ids = ids & 0xFFFF
        starts = np.cumsum(n[some]) - n[some]
        if n.max() >> FIELD:  # more ids than a field counts
            for k in range(DIMS):
                totals[some, k] = 2 * np.add.reduceat((self.plus >> (FIELD * k) & 1)[ids], starts) - n[some]
        else:
            plus = np.add.reduceat(self.plus[ids], starts)
            for k in range(DIMS):
                totals[some, k] = 2 * (plus >> (FIELD * k) & ((1 << FIELD) - 1)) - n[some]
        return totals

    def part(self, p: str) -> bytes:
        """The ids of one pre-token."""
        have = self.at.get(p)
        if have is None:
            if p.isascii():
                shown = "\u0120" + p[1:] if p[0] == " " else p
            else:
                shown = p.encode().decode("latin-1").translate(self.shown)
            have = self.at[p] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return have

    def encode(self, w: str) -> bytes:
        bare = w[1:] if w[0] == " " else w
        if w.isascii() and bare.isalpha():
            return self.part(w)
        if w.isascii() and bare[-1:] in ",.;:!?" and bare[:-1].isalpha():
            return self.part(w[:-1]) + self.part(w[-1])
        if m := self.plain(w):
            return self.part(m[1]) + (self.part(m[2]) if m[2] else b"")
        return array(self.code, self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words."""
        at, tokenize, code = self.at, self.model.tokenize, self.code
        for w in words:
            if w[0] == " " and w.isascii() and w[1:].isalpha():  # one pre-token, and most words
                at[w] = array(code, [t.id for t in tokenize("\u0120" + w[1:])]).tobytes()
            else:
                at[w] = self.encode(w)

    def documents(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text as bytes, and the texts' keys."""
        coded = []
        for t in texts:
            ws = t.replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK) if self.quick(t) else self.split(t)
            try:
                coded.append(b"".join(map(self.at.__getitem__, ws)))
            except KeyError:
                new = {w for w in ws if w not in self.at}
                if len(self.at) + len(new) > CACHE_WORDS:
                    self.at, new = {}, set(ws)
                self.learn(new)
                coded.append(b"".join(map(self.at.__getitem__, ws)))
        return coded, curve_keys(self.sums(coded), np.array([len(c) // self.kind.itemsize for c in coded]))


def _slices(batches, rows: int = 256):
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and, with_ids, ids array<int>).

    A document is its ids and end_id; it is cut only where a sequence of `length` ids is full, and each id lies in one
    piece. offset counts from 0 in a sequence, without gaps. A null or empty text is one id, end_id. Rows that repeat an
    id are packed each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    # every row is drawn, and placed among rows of its key, for itself; the two scans may number rows differently
    base = base.withColumn("tie", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 32)))
    count = base.count()

    def keys(batches):
        words = Words.of(path)
        for b in _slices(batches):
            texts = b.column("t").to_pylist()
            _, ks = words.documents(texts)
            order = [pa.array(ks, pa.int64()), b.column("tie"), pa.array([len(t) + 1 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(order, names=["key", "tie", "size"])

    def drawn(rows: int) -> tuple[np.ndarray, float]:
        """(key, tie, size) of about so many rows, in order, and the share that they are."""
        share = min(1.0, rows / max(count, 1))
        some = base.where(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else base
        return np.array(sorted(tuple(r) for r in some.mapInArrow(keys, "key long, tie long, size long").collect()), np.int64).reshape(-1, 3), share

    sample, share = drawn(SAMPLE_DOCS)
    ranges = int(np.clip(sample[:, 2].sum() / share / RANGE_BYTES, 1, MAX_RANGES))
    if ranges * PER_RANGE > SAMPLE_DOCS and share < 1:
        sample, share = drawn(ranges * PER_RANGE)
    order = (sample[:, 0] << 32) | sample[:, 1]
    reach = np.cumsum(sample[:, 2])
    at = np.searchsorted(reach, np.arange(1, ranges) * (reach[-1] / ranges)) if len(reach) else []
    cuts = spark.sparkContext.broadcast(np.unique(order[at]) if len(at) else np.zeros(0, np.int64))

    def encode(batches):
        words = Words.of(path)
        end = np.asarray([end_id], words.kind).tobytes()
        for b in _slices(batches):
            done, ks = words.documents(b.column("t").to_pylist())
            place = (ks << 32) | b.column("tie").to_numpy()
            part = np.searchsorted(cuts.value, place, side="right").astype(np.int32)
            arrays = [pa.array(part), pa.array(place), b.column("id"), pa.array([i + end for i in done], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "place", "id", "ids"])

    id_kind = dict(docs.dtypes)[id_col]
    coded = base.mapInArrow(encode, f"part int, place long, id {id_kind}, ids binary")
    parts = len(cuts.value) + 1
    dealt = coded.repartition(max(1, -(-parts // 3)), "part").sortWithinPartitions("part", "place", "id", "ids")

    def lay(batches):
        kind = Words.of(path).kind
        part, seq, at = None, 0, 0
        for b in _slices(batches):
            out = {"id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], "sequence_id": [], "offset": [], "ids": []}
            for row, (p, data) in enumerate(zip(b.column("part").to_pylist(), b.column("ids").to_pylist(), strict=True)):
                if p != part:
                    part, seq, at = p, 0, 0
                ids, start = np.frombuffer(data, kind).astype("<u4"), 0
                while start < len(ids):
                    n = min(length - at, len(ids) - start)
                    piece = ids[start : start + n]
                    for name, v in (("id", row), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(ids)), ("sequence_id", (p << 32) + seq), ("offset", at)):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
                    start, at = start + n, at + n
                    if at == length:
                        seq, at = seq + 1, 0
            cols = [b.column("id").take(pa.array(out["id"], pa.int64()))]
            cols += [pa.array(out[n], pa.int64()) for n in names[1:7]]
            cols += [pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{id_col}` {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return dealt.mapInArrow(lay, schema)
