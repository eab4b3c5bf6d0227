"""Token ids in binary blocks with Elias-Fano document boundaries.

A block holds the ids of consecutive documents as one little-endian array (two bytes an id while the
vocabulary allows it, else four), and as Elias-Fano sequences the ends of its documents and, as these ascend too,
their doc_ids: the low bits of each value packed, the high bits as a unary bit vector in which ``select`` finds the
i-th value. A boundary costs 2 + log2(ids / documents) bits. Blocks are rows of a table that Spark writes and commits,
so a task that is run again replaces its own blocks and any file system that Spark reads can hold them.

Texts are encoded where they lie; only their ids are shuffled into doc_id order.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bytes_of, chunks, if_small, release, scratch, text_of

MAGIC = b"EFT2"
#: A block is closed when it holds so many ids or documents, or its doc_ids lie so far apart.
BLOCK_IDS, BLOCK_DOCS, BLOCK_SPAN = 1 << 21, 1 << 15, 1 << 62
#: Every so many ones the position in the high bits is noted, so that select reads a short stretch.
SELECT_EVERY = 256
#: Bytes of words whose ids a Python worker remembers, and of text that is encoded at once.
CACHE_BYTES, TEXT_BYTES = 200_000_000, 1_000_000


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``universe``."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.universe = n, universe
        self.bits = self.low_bits(n, universe)
        self.low, self.high, self.sample = low, high, sample

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, int(universe // max(n, 1)).bit_length() - 1)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        k = cls.low_bits(len(values), universe)
        lows = ((values[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()
        ones = (values >> k) + np.arange(len(values))
        high = np.zeros((universe >> k) + len(values) + 1, dtype=np.uint8)
        high[ones] = 1
        return cls(len(values), universe, np.packbits(lows, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at places i. Ones are counted from the noted position before the first place to the one after the last."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return i
        first, after = int(i.min()) // SELECT_EVERY, int(i.max()) // SELECT_EVERY + 1
        byte = int(self.sample[first]) // 8
        end = int(self.sample[after]) // 8 + 1 if after < len(self.sample) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + byte * 8
        at = at[np.searchsorted(at, self.sample[first]) :]
        out = (at[i - first * SELECT_EVERY] - i) << self.bits
        for b in range(self.bits):
            bit = i * self.bits + b
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def search(self, value: int) -> int:
        """The first place whose value is at least this one, n if there is none: a binary search by select."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(np.array([mid]))[0] < value else (low, mid)
        return low

    def dump(self) -> bytes:
        return struct.pack("<QQII", self.n, self.universe, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, low, high = struct.unpack_from("<QQII", data, at)
        at += 24
        noted = -(-n // SELECT_EVERY)
        end = at + low + high + 4 * noted
        return cls(n, universe, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", noted, at + low + high)), end


def pack(doc_ids: list[int | None], ids: bytes, ends: np.ndarray, width: int) -> bytes:
    """A block: header, how many documents come first without doc_id, doc_ids from the first on, boundaries, ids."""
    nulls = sum(d is None for d in doc_ids)
    first, last = (doc_ids[nulls], doc_ids[-1]) if nulls < len(doc_ids) else (0, 0)
    names = np.array(doc_ids[nulls:], dtype=np.int64) - first
    head = struct.pack("<4sBIIq", MAGIC, width, len(doc_ids), nulls, first)
    return head + EliasFano.of(names, last - first).dump() + EliasFano.of(ends, len(ids) // width).dump() + ids


class Block:
    """A block's documents: doc_ids, ends and ids are found in its bytes when they are asked for."""

    def __init__(self, data: bytes):
        magic, width, self.docs, self.nulls, self.first = struct.unpack_from("<4sBIIq", data, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.names, at = EliasFano.load(data, 21)
        self.ends, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.ends.universe, at)

    def doc_ids(self) -> pa.Array:
        return pa.concat_arrays([pa.nulls(self.nulls, pa.int64()), pa.array(self.names.select(np.arange(self.names.n)) + self.first)])

    def of(self, doc_id: int) -> Iterator[np.ndarray]:
        """The ids of each document of this doc_id."""
        i = self.names.search(doc_id - self.first)
        while i < self.names.n and self.names.select(np.array([i]))[0] == doc_id - self.first:
            place = self.nulls + i
            begin, end = [0, *self.ends.select(np.array([0]))] if place == 0 else self.ends.select(np.array([place - 1, place]))
            yield self.ids[begin:end]
            i += 1


#: Stands between words that are encoded in one call. Words that hold it are encoded by themselves.
MARK = "\x01"
#: What may follow a letter or digit at the end of a word as a token by itself.
STOPS = b".,;:!?"
PLAIN_PROBES = ["word", "a", "internationalization", "größe", "éñçà", "привет", "λόγος", "日本語", "ﬁn", "ªº"]
PROBES = ["a word, and A Word!", "it's 12.5; x", "UPPER\u00c9 \u00fc\u00f1 e\u0301.", "tab\tline\nend  two", "a.b ... (c), d?!"]


class Encoder:
    """A tokenizer and the ids of words met before: it stays with the Python worker.

    What saves work is tried on probes first; a tokenizer that doesn't pass encodes whole texts. By words: no token spans
    white space, and it lowers letters, so each word, with A-Z lowered, is encoded once. By stops: the stops after a
    letter or digit are tokens apart from it. Plain: words of lower-case letters in normal form alone need no
    normalizing and no pattern.
    """

    known_encoders: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.kind = Tokenizer.from_file(path), width, f"<u{width}"
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        mark = self.ids(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.low_specials = [s.lower() for s in self.specials]
        same = lambda text, parts: np.array_equal(self.ids(text), np.concatenate([self.ids(p) for p in parts]))
        cased = [f"see {form(s.decode())} here, x{form(s.decode())}y" for s in self.specials for form in (str, str.upper, str.lower, str.title, str.swapcase)]
        split = {p: [w.decode() for w in self.words(p.encode())] for p in (*PROBES, *cased)}
        self.by_words = all(same(p, words) and same(f" {MARK} ".join(words), f" {MARK} ".join(words).split()) for p, words in split.items())
        self.by_stops = self.by_words and all(same(f"{w}{s}", [w, s]) for w in ("word", "x1", "it's") for s in (".", ",", "?!", "...", ";:"))

        self.plain = self.without_patterns(path)

    def without_patterns(self, path: str):
        """The same tokenizer for words that ``is_plain`` says yes to, None if it gives other ids."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = f" {MARK} ".join(PLAIN_PROBES)
        same = np.array_equal(plain.encode(probe, add_special_tokens=False).ids, self.ids(probe))
        return plain if self.by_words and self.mark is not None and same else None

    @classmethod
    def of(cls, path: str, width: int) -> Encoder:
        if (path, width) not in cls.known_encoders:
            cls.known_encoders[path, width] = cls(path, width)
        return cls.known_encoders[path, width]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, A-Z lowered unless it then holds a special token, which case tells from other text."""
        low = text.lower()
        return (text if any(s in low for s in self.low_specials) else low).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian integers."""
        if not self.by_words:
            return [self.ids(t.decode()).tobytes() for t in texts]
        parts = [self.words(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = set(chain.from_iterable(parts)).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def learn(self, words: set[bytes]) -> None:
        stems: dict[bytes, bytes] = {}
        if self.by_stops:
            for w in words:
                if w[-1] in STOPS and not any(s in w for s in self.specials):
                    stem = w.rstrip(STOPS)
                    if stem and stem[-1:].isalnum():
                        stems[w] = stem
        whole = set(words).difference(stems).union(stems.values()).union(w[len(s) :] for w, s in stems.items()).difference(self.known)
        byte = MARK.encode()
        alone = [w for w in whole if self.mark is None or byte in w]
        for w in alone:
            self.keep(w, self.ids(w.decode()).tobytes())
        many = [w for w in whole if byte not in w] if self.mark is not None else []
        plain = [w for w in many if self.plain is not None and is_plain(w.decode())]
        self.learn_many(self.plain, plain)
        self.learn_many(self.tokenizer, list(set(many).difference(plain)))
        for w, stem in stems.items():
            self.keep(w, self.known[stem] + self.known[w[len(stem) :]])

    def learn_many(self, tokenizer, words: list[bytes]) -> None:
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        between, width = f" {MARK} ".encode(), self.width
        for low in range(0, len(groups), 50):
            some = groups[low : low + 50]
            for group, e in zip(some, tokenizer.encode_batch_fast([between.join(g).decode() for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.kind)
                raw, at = ids.tobytes(), 0
                for w, end in zip(group, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                    self.keep(w, raw[at * width : end * width])
                    at = end + 1

    def keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + 170


def is_plain(word: str) -> bool:
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, vocabulary: int = 49_408, rows_per_file: int = 20_000) -> None:
    """Encode all documents (doc_id, text) and write blocks in ascending doc_id order to ``path``.

    A null text is empty and holds the end id alone; a null doc_id comes first; rows with one doc_id stand next to
    each other, in no stated order. An empty table writes an empty table of blocks. Other columns are ignored.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    count = rows.count()
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // rows_per_file))
    # doc_ids that stand about a file's rows apart: one number a file
    cuts = rows.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 20 * files).alias("cuts")).head()["cuts"] if files > 1 else None
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, width), end_id.to_bytes(width, "little")
        for some in chunks(batches, "text", TEXT_BYTES):
            ids = [x + end for x in encoder.encode(bytes_of(some.column("text")))]
            names = some.column("doc_id")
            # a doc_id that fills several files is dealt over them by its rows' ids
            of = names.fill_null(-(1 << 63)).to_numpy()
            low, high = np.searchsorted(bounds.value, of, "left"), np.searchsorted(bounds.value, of, "right")
            part = np.where(names.is_null().to_numpy(zero_copy_only=False), 0, low)
            for i in np.flatnonzero(high > low).tolist():
                part[i] = low[i] + zlib.crc32(ids[i]) % (high[i] - low[i] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), names, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])
        release()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = number = total = 0
        names: list[int | None] = []
        parts: list[bytes] = []
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal names, parts, ends, total, number
            known = [d for d in names if d is not None]
            row = {"part": [part], "block": [number], "n_docs": [len(names)], "n_ids": [total], "first_id": known[:1] or [None], "last_id": known[-1:] or [None], "data": [pack(names, b"".join(parts), np.array(ends), width)]}
            names, parts, ends, total, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(row["part"], pa.int32()), pa.array(row["block"], pa.int32()), *(pa.array(row[c], pa.int64()) for c in ("n_docs", "n_ids", "first_id", "last_id")), pa.array(row["data"], pa.binary())], list(row))

        for batch in batches:
            for p, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if names and (p != part or total >= BLOCK_IDS or len(names) >= BLOCK_DOCS or (d is not None and names[0] is not None and d - names[0] >= BLOCK_SPAN) or (d is not None and names[0] is None)):
                    yield close()
                if p != part:
                    part, number = p, 0
                names.append(d)
                parts.append(ids)
                total += len(ids) // width
                ends.append(total)
        if names:
            yield close()
        release()

    coded = rows.mapInArrow(encode, "part int, doc_id long, ids binary")
    ordered = coded.repartitionById(files, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


BLOCKS = "part int, block int, n_docs long, n_ids long, first_id long, last_id long, data binary"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document from the blocks: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # running sums over parts, then over the blocks of a part: both tables have one row a block at most
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    starts = inside.join(base, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("first"))
    placed = blocks.join(if_small(starts), ["part", "block"]).select("first", "data")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py())
                ends = block.ends.select(np.arange(block.docs))
                begins = np.concatenate([[0], ends[:-1]])
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [block.doc_ids(), pa.array(begins + first), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([wide[a:b].astype(np.int32) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [k for k, _ in kinds])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(rows, schema)


def find_tokens(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of each document of this doc_id: only blocks that may hold it are read, and only its ids are decoded."""
    blocks = spark.read.schema(BLOCKS).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(Block(data.as_py()).of(doc_id))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return blocks.select("data").mapInArrow(rows, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the documents' token files and return what is read back from them."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, tokenizer, path, **options)
    return read_tokens(spark, path)
