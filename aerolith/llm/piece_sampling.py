"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

Every way to spell a text in pieces is a path through a lattice. Forward filtering adds up the weights of all
paths that end at each character; walking back from the end, each piece is then drawn in proportion to the
weight of the paths through it. Draws are a hash of the row's key and the place in the text, so an encoding can be
made again. No piece goes on with a space after another character, so lattices are built once for each distinct word
with the spaces before it, and all words of a batch are walked at the same time. Characters without a piece are spelled in bytes; decoding gives back the exact text.

The model file holds merge ranks, not probabilities: the piece of rank r weighs (r + 1) ** -sharpness.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, text_of

SPACE = "▁"
#: Stand for a space mark and a line feed in the text itself, which are spelled in bytes. No text in UTF-8 holds them.
MARK = "\ud800\ud801"
#: Segments of more characters have their sums scaled on the way, as these would grow too small for a float.
SEGMENT = 48
#: Spaces, and what follows up to the next space.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Spaces after another character, within a piece.
INNER = re.compile(f"[^{SPACE}]{SPACE}")
#: Segments whose lattices a task keeps.
CACHE_SEGMENTS = 100_000
#: Characters of segments whose lattices a task keeps, as some segments are long.
CACHE_CHARS = 500_000
#: Characters of new segments whose lattices are built at once: their edges take some 500 bytes a character on the way.
SLICE_CHARS = 60_000
#: Bytes of text that are sampled at once.
BATCH_BYTES = 500_000


class Lattices:
    """The lattices of all segments met so far, as flat arrays of nodes and of edges into each node."""

    def __init__(self, model_file: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, dtype=np.int64)
        weights = np.zeros(model.get_piece_size())
        pieces: dict[str, int] = {}
        first = None
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes_of.append(b"")
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if INNER.search(piece) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses the border of a segment")
                first = i if first is None else first
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                weights[i] = (i - first + 1.0) ** -sharpness
                pieces[piece] = i
        self.weights = weights
        self.longest = max(map(len, pieces))
        #: a character in bytes weighs less than any piece
        self.byte_weight = float(weights[weights > 0].min()) / 2
        # the prefixes of all pieces as nodes of a tree: the nodes after each first character, a hash table of keys (node,
        # next character), and the piece that ends at a node
        node = {"": 0}
        step: dict[int, int] = {}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in node:
                    node[piece[:k]] = len(node)
                    step[(node[piece[: k - 1]] << 21) | ord(piece[k - 1])] = node[piece[:k]]
        key, to = np.array(list(step), dtype=np.int64), np.array(list(step.values()), dtype=np.int64)
        self.root = np.full(sys.maxunicode + 1, -1, dtype=np.int64)
        self.root[key[key >> 21 == 0]] = to[key >> 21 == 0]
        self.bits = len(step).bit_length() + 2
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int64)
        slot = self.slot(key)
        while len(key):
            free, first_of = np.unique(slot, return_index=True)
            first_of = first_of[self.slot_key[free] < 0]
            self.slot_key[slot[first_of]], self.slot_to[slot[first_of]] = key[first_of], to[first_of]
            key, to, slot = (np.delete(x, first_of) for x in (key, to, slot))
            slot = (slot + 1) & ((1 << self.bits) - 1)
        self.piece_at = np.full(len(node), -1, dtype=np.int64)
        for piece, i in pieces.items():
            self.piece_at[node[piece]] = i
        del node, step
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ends = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.within = np.zeros(0)
        self.first = np.zeros(0, dtype=np.int32)
        self.source = np.zeros(0, dtype=np.int32)
        self.code = np.zeros(0, dtype=np.int32)
        self.nodes = 0

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Where a key is looked for first."""
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each node and character, -1 if there is none."""
        key = (node << 21) | char
        slot = self.slot(key)
        held = self.slot_key[slot]
        out = np.where(held == key, self.slot_to[slot], -1)
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[slot[more]]
            same = held == key[more]
            out[more[same]] = self.slot_to[slot[more[same]]]
            more = more[~same & (held >= 0)]
        return out

    def matches(self, chars: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """By length, the ends and pieces of all pieces in the text, which ends in a line feed; all starts walk down the tree together."""
        node = self.root[chars]
        at = np.flatnonzero(node >= 0)
        node, size = node[at], 1
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        while len(at):
            piece = self.piece_at[node]
            hit = piece >= 0
            found.append((at[hit] + size, size, piece[hit]))
            node = self.step(node, chars[at + size])  # a walk ends at a line feed, so before the text does
            go = np.flatnonzero(node >= 0)
            at, node = at[go], node[go]
            size += 1
        return found

    def add(self, segments: list[str]) -> None:
        """Forward filtering for new segments, a slice at a time."""
        ends = np.cumsum(np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)) + 1)
        held = [(self.within, self.first, self.source, self.code, self.starts, self.ends)]
        edges, low, before = len(self.within), 0, 0
        while low < len(segments):
            high = max(low + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right")))
            held.append(self.filtered(segments[low:high], edges))
            edges += len(held[-1][0])
            low, before = high, int(ends[high - 1])
        self.index.update(zip(segments, range(len(self.ends), len(self.ends) + len(segments)), strict=True))
        self.within, self.first, self.source, self.code, self.starts, self.ends = (np.concatenate(x) for x in zip(*held, strict=True))

    def filtered(self, segments: list[str], edges: int) -> tuple[np.ndarray, ...]:
        """Edges and nodes of these segments, which go behind the nodes and so many edges. A code of -1 - c stands for character c in bytes."""
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        # each segment is followed by a line feed, which no piece holds: its place is the segment's end node
        chars = np.frombuffer(("\n".join(segments) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        found = self.matches(chars)
        alone = chars != 10
        for e in (e for e, n, _ in found if n == 1):
            alone[e - 1] = False
        lone = np.flatnonzero(alone)
        found.append((lone + 1, 1, -1 - chars[lone]))
        # edges in order of their ends: of one length, no two have the same
        per_end = np.zeros(len(chars) + 1, dtype=np.int64)
        for e, _, _ in found:
            per_end[e] += 1
        free = np.cumsum(per_end) - per_end
        end = np.repeat(np.arange(len(per_end)), per_end)
        size, code = np.empty(len(end), dtype=np.int64), np.empty(len(end), dtype=np.int64)
        for e, n, c in found:
            at = free[e]
            size[at], code[at] = n, c
            free[e] = at + 1
        weight = np.where(code >= 0, self.weights[np.maximum(code, 0)], self.byte_weight)
        alpha = np.zeros(len(chars) + 1)
        alpha[base[:-1]] = 1.0
        depth = end - np.repeat(base[:-1], lengths + 1)[end - 1]
        most = int(lengths.max())
        by_depth = np.argsort(depth.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # sorted in two passes if small
        bounds = np.cumsum(np.bincount(depth, minlength=most + 1))
        e, source, by_weight = end[by_depth], (end - size)[by_depth], weight[by_depth]
        share = np.empty(len(end))
        # edges of one end stand together
        runs = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        wide, run_bounds = np.diff(np.append(runs, len(e))), np.searchsorted(runs, bounds)
        long = np.flatnonzero(lengths > SEGMENT)
        back = np.arange(self.longest)
        for at in range(1, most + 1):
            low, high = bounds[at - 1], bounds[at]
            if low < high:
                part = alpha[source[low:high]] * by_weight[low:high]
                run = slice(run_bounds[at - 1], run_bounds[at])
                total = np.add.reduceat(part, runs[run] - low)
                alpha[e[runs[run]]] = total
                share[low:high] = part / np.repeat(total, wide[run])
            if at % self.longest == 0 and len(long):
                # of a long segment the nodes that pieces to come can begin at; only their ratios count from here on
                long = long[lengths[long] > at]
                recent = base[long][:, None] + at - back
                alpha[recent] /= alpha[recent].max(axis=1, keepdims=True)
        mass = np.empty(len(end))
        mass[by_depth] = share
        group = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1])
        counts = per_end[end[group]]
        running = np.cumsum(mass) - np.repeat(np.arange(len(group)), counts)
        running[group + counts - 1] = 2.0  # a draw never passes a node's last edge, however sums are rounded
        first = np.full(len(chars) + 1, -1, dtype=np.int64)
        first[end[group]] = group + edges
        begin = self.nodes
        self.nodes += len(chars) + 1
        nodes = base[:-1] + begin
        return running, first.astype(np.int32), (end - size + begin).astype(np.int32), code.astype(np.int32), nodes, nodes + lengths

    def sample(self, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of one path for each segment; returns codes in reading order, and path lengths."""
        at, stop = self.ends[which].copy(), self.starts[which]
        alive = np.flatnonzero(at > stop)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(which), dtype=np.int64)
        k = 0
        while len(alive):
            u = uniform(seeds[alive] + np.uint64(k))
            edge = self.first[at[alive]]
            over = np.flatnonzero(self.within[edge] <= u)
            while len(over):
                edge[over] += 1
                over = over[self.within[edge[over]] <= u[over]]
            steps.append((alive, self.code[edge]))
            counts[alive] += 1
            at[alive] = self.source[edge]
            alive = alive[at[alive] > stop[alive]]
            k += 1
        offsets = np.cumsum(counts)
        out = np.empty(int(offsets[-1]) if len(offsets) else 0, dtype=np.int64)
        for k, (who, code) in enumerate(steps):
            out[offsets[who] - 1 - k] = code
        return out, counts


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers to [0, 1)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(model_file: str, sharpness: float) -> Lattices:
    """Built once for each Python worker."""
    key = (model_file, sharpness)
    if key not in _LATTICES:
        _LATTICES[key] = Lattices(model_file, sharpness)
    return _LATTICES[key]


def segments_of(text: str) -> list[str]:
    """Segments of a text, whose borders no piece crosses: each is a word with the space marks before it, or a line's end within."""
    spaced = SPACE + text.replace(SPACE, MARK[0]).replace("\n", MARK[1]).replace(" ", SPACE)
    words = WORD.findall(spaced) if SPACE * 2 in spaced else spaced.replace(SPACE, "\n" + SPACE)[1:].split("\n")
    if max(map(len, words)) <= SEGMENT:
        return words
    # no piece holds a line feed
    return [p for w in words for p in (w.replace(MARK[1], MARK[1] + "\n").split("\n") if len(w) > SEGMENT else [w]) if p]


def encode_texts(texts: list[str], keys: list[int], model_file: str, sharpness: float) -> list[np.ndarray]:
    """Sampled piece ids of each text; the empty text has none."""
    tables = lattices(model_file, sharpness)
    split = [segments_of(t) if t else [] for t in texts]
    met = set().union(*split)
    new = list(met.difference(tables.index))
    if len(tables.index) + len(new) > CACHE_SEGMENTS or tables.nodes + sum(map(len, new)) > CACHE_CHARS:
        tables.forget()
        new = list(met)
    if new:
        tables.add(new)
    counts = np.array([len(x) for x in split], dtype=np.int64)
    which = np.fromiter(map(tables.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
    with np.errstate(over="ignore"):
        row = np.repeat(np.array([zlib.crc32(str(k).encode()) for k in keys], dtype=np.uint64) << np.uint64(32), counts)
        place = np.concatenate([np.arange(n, dtype=np.uint64) for n in counts]) if len(counts) else np.zeros(0, dtype=np.uint64)
        seeds = (row + place) * np.uint64(0x9E3779B97F4A7C15)
    codes, lengths = tables.sample(which, seeds)
    per_text = np.add.reduceat(np.concatenate([lengths, [0]]), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)) if len(counts) else counts
    per_text = np.where(counts > 0, per_text, 0)
    if (codes < 0).any():
        codes, per_text = _spell(codes, per_text, tables)
    return np.split(codes, np.cumsum(per_text)[:-1])


def _spell(codes: np.ndarray, per_text: np.ndarray, tables: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters by the ids of their bytes."""
    chars, inverse = np.unique(codes[codes < 0], return_inverse=True)
    real = {ord(MARK[0]): SPACE, ord(MARK[1]): "\n"}
    raw = [real.get(int(-1 - c), chr(int(-1 - c))).encode("utf-8", "surrogatepass") for c in chars]
    size = np.ones(len(codes), dtype=np.int64)
    size[codes < 0] = np.array([len(b) for b in raw])[inverse]
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(codes, size)
    wide = np.zeros((len(raw), 4), dtype=np.int64)
    for i, b in enumerate(raw):
        wide[i, : len(b)] = tables.byte_id[list(b)]
    low = np.flatnonzero(codes < 0)
    for k in range(4):
        has = size[low] > k
        out[begin[low[has]] + k] = wide[inverse[has], k]
    owner = np.repeat(np.arange(len(per_text)), per_text)
    return out, np.bincount(owner, size, len(per_text)).astype(np.int64)


def decode(ids: np.ndarray, model_file: str, sharpness: float = 1.0) -> str:
    """The text of piece ids: their bytes, without the space that stands before the first word."""
    table = lattices(model_file, sharpness).bytes_of
    return b"".join(map(table.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def sampled_pieces(docs: DataFrame, model_file: str, sharpness: float = 1.0, with_text: bool = False) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_pieces, piece_ids, decoded_sha256 (or decoded).

    The same doc_id and text always give the same pieces. A null text is empty: no pieces, decoded to the empty text.
    A null doc_id is a key like any other; rows may repeat; no rows give no rows; other columns are ignored.
    """
    import hashlib

    last = pa.field("decoded", pa.string()) if with_text else pa.field("decoded_sha256", pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("piece_ids", pa.list_(pa.int32())), last])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches, "text", BATCH_BYTES):
            names, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
            pieces = encode_texts(texts, names, model_file, sharpness)
            back = [decode(p, model_file, sharpness) for p in pieces]
            back = back if with_text else [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
            sizes = np.array([len(p) for p in pieces], dtype=np.int64)
            flat = pa.array(np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes), listed, pa.array(back, pa.string())], schema=schema)
        lattices(model_file, sharpness).forget()
        release()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return picked.mapInArrow(rows, "doc_id long, n_pieces long, piece_ids array<int>, " + f"{last.name} string")
