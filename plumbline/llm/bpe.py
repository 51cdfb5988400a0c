"""BPE encoding and decoding by a table of distinct words.

Spark cuts texts at white space and deals them out in blocks; a block has a list of its distinct words, the frequent ones
first. The lists meet by classes of words, and each distinct word of all texts is encoded once, in the task of its class.
Its ids go back to the blocks that have it, where the ranks of a text's words put them into their positions. The pieces
that a block decodes with come from a join of its distinct ids with the vocabulary.

A word crosses the network once for each block that has it, however often it occurs there, so that no word is hot; a text
crosses once, as the deflated ranks of its words. Nothing is gathered on the driver, and tasks hold a block or a class.

White space never lies inside a token of a vocabulary whose pre-tokenizer drops it, so that words can be encoded apart.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import stored, text_or_empty

BLOCK_CHARS = 32_000_000  # of text in a block, about, at most
# Fixed value: the white space of the vocabulary's normaliser (Unicode White_Space), as a pattern.
BLANKS = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece), special tokens included."""
    import pandas as pd

    rows = [(i, p) for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"])).select(F.col("id").cast("int").alias("id"), "piece")


def decode_ids(rows: DataFrame, vocab: DataFrame, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, decoded): pieces of the ids joined by blanks, through a join of ids and vocabulary. Keys are unique.

    An id that the vocabulary lacks gives no piece; no ids, or null, decode to the empty text.
    """
    flat = rows.select(key, F.posexplode(ids_col).alias("pos", "id"))
    pieces = flat.join(F.broadcast(vocab), "id")  # a vocabulary has a fixed size
    got = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("ps"))
    got = got.select(key, F.array_join(F.col("ps.piece"), " ").alias("decoded"))
    return rows.select(key).join(got, key, "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))


def cut(text: Column) -> Column:
    """The words of a text, with a line break between each two."""
    return F.regexp_replace(text, BLANKS, "\n")


def _words(t: str) -> list[str]:
    t = t.strip("\n")
    return t.split("\n") if t else []


class Block:
    """Some rows of a task: key (a hash of their texts), words (distinct, frequent ones first), and the class of each."""

    def __init__(self, rows: list[pa.RecordBatch], counts: Counter, digest, classes: int):
        self.rows, self.key = rows, int.from_bytes(digest.digest(), "little", signed=True)
        self.words = [w for w, _ in counts.most_common()]
        self.classes = np.fromiter((zlib.crc32(w.encode()) % classes for w in self.words), np.int32, len(self.words))


def blocks(batches, classes: int, limit: int):
    """Blocks of the rows of a task, column t being cut; the same rows give the same blocks."""
    rows, chars, counts, digest = [], 0, Counter(), hashlib.blake2b(digest_size=8)
    for b in batches:
        for a in range(0, b.num_rows, 1000):
            part = b.slice(a, 1000)
            for t in part.column("t").to_pylist():
                digest.update(t.encode() + b"\0")
                counts.update(_words(t))
                chars += len(t)
            rows.append(part)
            if chars >= limit:
                yield Block(rows, counts, digest, classes)
                rows, chars, counts, digest = [], 0, Counter(), hashlib.blake2b(digest_size=8)
    if rows:
        yield Block(rows, counts, digest, classes)


def word_lists(base: DataFrame, classes: int) -> DataFrame:
    """(block, class, words) of base(id, t): the distinct words of each block, in the order of the block, by class."""

    def run(batches):
        for b in blocks(batches, classes, BLOCK_CHARS):
            order = np.argsort(b.classes, kind="stable")
            cls, first = np.unique(b.classes[order], return_index=True)
            ends = [*first[1:], len(order)]
            for a in range(0, len(cls), 256):
                span = range(a, min(a + 256, len(cls)))
                words = ["\n".join([b.words[i] for i in order[first[k] : ends[k]]]) for k in span]
                yield pa.RecordBatch.from_arrays([pa.array([b.key] * len(span), pa.int64()), pa.array(cls[a : a + 256]), pa.array(words, pa.string())], names=["block", "class", "words"])

    return base.mapInArrow(run, "block long, class int, words string")


def encode_words(lists: DataFrame, path: str, tasks: int) -> DataFrame:
    """(block, class, ids array<int>, sizes binary) of word_lists(): classes meet, and each distinct word is encoded once.
    sizes: the number of ids of each word, as 32-bit numbers."""

    def run(batches):
        tok, cls, known = tokenizer(path), None, {}
        for b in batches:
            ids, sizes = [], []
            for c, words in zip(b.column("class").to_pylist(), b.column("words").to_pylist(), strict=True):
                if c != cls:
                    cls, known = c, {}
                ws = words.split("\n")
                for w in ws:
                    if w not in known:
                        known[w] = array("i", tok.encode(w, add_special_tokens=False).ids)
                found = [known[w] for w in ws]
                ids.append(np.frombuffer(b"".join(found), np.int32))
                sizes.append(np.fromiter(map(len, found), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("class"), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.binary())], names=["block", "class", "ids", "sizes"])

    return lists.repartition(tasks, "class").sortWithinPartitions("class").mapInArrow(run, "block long, class int, ids array<int>, sizes binary")


def ranked_texts(base: DataFrame, classes: int) -> DataFrame:
    """(block, id, packed) of base(id, t): a text as ranks of its words in the block's list (32-bit, deflated); and for each
    block a row without packed, whose classes has the classes of its words by rank."""

    def run(batches):
        for b in blocks(batches, classes, BLOCK_CHARS):
            rank = {w: i for i, w in enumerate(b.words)}
            kind = b.rows[0].schema.field("id").type
            names = ["block", "id", "packed", "classes"]
            head = zlib.compress(b.classes.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
            yield pa.RecordBatch.from_arrays([pa.array([b.key], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([head], pa.binary())], names=names)
            for batch in b.rows:
                packed = []
                for t in batch.column("t").to_pylist():
                    ws = _words(t)
                    at = np.fromiter(map(rank.__getitem__, ws), np.int32, len(ws))
                    # planes of bytes deflate better than whole numbers
                    packed.append(zlib.compress(at.view(np.uint8).reshape(-1, 4).T.tobytes(), 6))
                yield pa.RecordBatch.from_arrays([pa.array([b.key] * len(packed), pa.int64()), batch.column("id"), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], names=names)

    return base.mapInArrow(run, f"block long, id {dict(base.dtypes)['id']}, packed binary, classes binary")


def _planes(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, steady: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256 (UTF-8);
    with texts also ids array<int> and decoded.

    A null text counts as empty and has no tokens. Null and repeated ids are rows like others; an empty table gives no
    rows; other columns of docs are ignored. Rows are read twice and have to come in the same partitions and order then:
    steady says that docs is a scan of files, where they do; else id and text are stored first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), cut(text_or_empty(text_col)).alias("t"))
    if not steady:
        base = stored(base, "bpe-texts")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = 16 * tasks  # words of a class stay few as texts and tasks grow
    encoded = stored(encode_words(word_lists(base, classes), path, tasks), "bpe-words")
    ids = encoded.select("block", F.explode(F.array_distinct("ids")).alias("piece_id")).distinct()
    pieces = ids.join(F.broadcast(vocabulary(spark, path).withColumnRenamed("id", "piece_id")), "piece_id")  # a vocabulary has a fixed size
    none = lambda kind: F.lit(None).cast(kind)
    id_kind = dict(base.dtypes)["id"]
    columns = {"id": id_kind, "packed": "binary", "classes": "binary", "class": "int", "ids": "array<int>", "sizes": "binary", "piece_id": "int", "piece": "string"}

    def part(kind: Column, rows: DataFrame) -> DataFrame:
        return rows.select("block", kind.alias("kind"), *[F.col(c) if c in rows.columns else none(k).alias(c) for c, k in columns.items()])

    met = part(F.lit(0), pieces).unionByName(part(F.lit(1), encoded)).unionByName(part(F.when(F.col("packed").isNull(), 2).otherwise(3), ranked_texts(base, classes)))
    met = met.repartition(tasks, "block").sortWithinPartitions("block", "kind")

    def digest(batches):
        block, piece, lists, ids_of, text_of = None, {}, {}, [], []
        for b in batches:
            n, h, g, all_ids, decoded, rows = [], [], [], [], [], []
            get = {c: b.column(c) for c in b.schema.names}
            for i, (key, kind) in enumerate(zip(get["block"].to_pylist(), get["kind"].to_pylist(), strict=True)):
                if key != block:
                    block, piece, lists, ids_of, text_of = key, {}, {}, [], []
                if kind == 0:
                    piece[get["piece_id"][i].as_py()] = get["piece"][i].as_py()
                elif kind == 1:
                    ends = np.cumsum(np.frombuffer(get["sizes"][i].as_py(), np.int32)).tolist()
                    lists[get["class"][i].as_py()] = iter(np.split(get["ids"][i].values.to_numpy().astype("<u4"), ends[:-1])) if ends else iter(())
                elif kind == 2:
                    if not ids_of:  # equal blocks are one
                        ids_of = [next(lists[c]) for c in _planes(get["classes"][i].as_py()).tolist()]
                        text_of = [" ".join([piece[x] for x in w.tolist()]) for w in ids_of]
                        ids_of = [w.tobytes() for w in ids_of]
                else:
                    seq = _planes(get["packed"][i].as_py()).tolist()
                    data = b"".join([ids_of[r] for r in seq])
                    text = " ".join([text_of[r] for r in seq if ids_of[r]])
                    rows.append(i)
                    n.append(len(data) // 4)
                    h.append(hashlib.sha256(data).hexdigest())
                    g.append(hashlib.sha256(text.encode()).hexdigest())
                    if texts:
                        all_ids.append(np.frombuffer(data, "<u4").astype(np.int32))
                        decoded.append(text)
            arrays = [get["id"].take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(g, pa.string())]
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if texts else []
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays + more)]
            yield pa.RecordBatch.from_arrays(arrays + more, names=names)

    out = f"`{id_col}` {id_kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return met.mapInArrow(digest, out)
