"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece of text (a match of the pattern) starts as its bytes. Leaf i of the tree holds the rank of the pair that starts at live
position i, with i in the low bits; the root is then the leftmost pair of least rank. A merge joins a position with its live
neighbour and changes three leaves, each by a path to the root: O(n log n) for a piece of n bytes, whatever it holds. Short pieces
of a slice of texts are merged side by side, their trees as arrays.

A whole text is read by one row of an Arrow batch and no row is moved. Texts of SLICE_BYTES, or one longer text, are taken together:
their pieces are an Arrow array over the texts' own bytes, each distinct one is merged once, and ids are gathered for all. Pieces
repeat, so each worker keeps the ids of short ones, CACHED of them and a slice's at most; that saves time only.

Defined results: a null text is an empty one; an empty text has no ids; texts of any length are encoded whole; repeated rows are
encoded alike; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import table

CACHED, CACHED_BYTES = 500_000, 64
SIDE_BY_SIDE, MANY = 64, 8192
SLICE_BYTES = 8_000_000

# The pattern whose matches boundaries() finds without an engine.
BY_CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Code points that this pattern engine holds for letters and numbers and that of the tiktoken library, whose
# Unicode tables are older, does not. Texts that hold one are split with the classes less these.
YOUNG_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
YOUNG_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _chars(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in ranges.split())


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, one value after the other, and where each begins and the last one ends; a null is empty."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    _, at, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    at = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array over data, whose values begin and end at the places at."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then the same for the others."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(counts.sum())


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


_OTHER, _LETTER, _NUMBER, _WHITE, _SPACE, _BEFORE = range(6)


@cache
def _classes() -> np.ndarray:
    """The class of each code point in BY_CLASSES, with the tiktoken library's letters and numbers."""
    out, chars = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    young = {_LETTER: _chars(YOUNG_LETTERS), _NUMBER: _chars(YOUNG_NUMBERS)}
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"\s")):
        for m in regex.finditer(f"{name}+", chars):
            out[m.start() : m.end()] = kind
    for kind, ranges in young.items():
        for m in regex.finditer(f"[{ranges}]+", chars):
            out[m.start() : m.end()] = np.where(out[m.start() : m.end()] == kind, _OTHER, out[m.start() : m.end()])
    out[0x20] = _SPACE
    return out


def boundaries(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where matches of BY_CLASSES begin in code points that hold texts one after the other, which begin at begins. Matches cover a text.

    A run of letters, numbers or others is a match, with a space right before it. Of a run of white space, what is not taken so
    is one match at a text's end; elsewhere its last character, if it is no space, is a match of its own. An apostrophe that would
    begin a match and the letters of a contraction are one.
    """
    n, table = len(chars), _classes()
    kind = np.empty(n, np.uint8)
    for k in range(0, n, 1 << 20):
        kind[k : k + (1 << 20)] = table[chars[k : k + (1 << 20)]]
    first = np.zeros(n + 3, bool)
    first[begins[begins < n]] = first[n:] = True
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = _BEFORE, kind[:-1]
    before[first[:n]] = _BEFORE
    white = kind >= _WHITE
    last = np.zeros(n, bool)  # of white space, with more text after it
    last[:-1] = ~white[1:] & ~first[1:n]
    start = np.zeros(n + 3, bool)
    start[:n] = np.where(white, last | (before < _WHITE) | (before == _BEFORE), (before != kind) & (before != _SPACE))
    at = np.flatnonzero(start[:n] & (chars == ord("'")))
    at = at[~first[at + 1]]
    one = chars[at + 1]
    short = at[np.isin(one, [ord(c) for c in "stmd"])]
    start[short + 1], start[short + 2] = False, True
    keep = ~first[at + 2]
    at, one = at[keep], one[keep]
    two = chars[at + 2]
    long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    start[long + 1], start[long + 3] = False, True
    return np.flatnonzero(start[:n])


def _split_by_classes(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    data, at = _raw(texts)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(chars) == len(data):
        starts = boundaries(chars, at[:-1])
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        starts = place[boundaries(chars, np.searchsorted(place, at[:-1]))]
    return _binary(data, np.append(starts, len(data))), np.searchsorted(starts, at)


def _split_by(find: Callable[[str], list[str]], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = [find(t or "") for t in texts.to_pylist()]
    return pa.array([p for ps in lists for p in ps], pa.large_string()).cast(pa.large_binary()), _bounds([len(ps) for ps in lists])


def splitter(pattern: str) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """A function that gives texts' matches of pattern, with the tiktoken library's letters and numbers: all matches, and where each text's begin and the last one's end."""
    if pattern == BY_CLASSES:
        return _split_by_classes
    letters, numbers = _chars(YOUNG_LETTERS), _chars(YOUNG_NUMBERS)
    exact = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
    fast, slow, young = regex.compile(pattern).findall, regex.compile(exact, regex.V1).findall, regex.compile(f"[{letters}{numbers}]").search
    return lambda texts: _split_by(lambda text: fast(text) if text.isascii() or not young(text) else slow(text), texts)


_NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, as the rank table merges it."""
    rank = ranks.get
    if (whole := rank(piece)) is not None:
        return [whole]
    n = len(piece)
    half = 1 << (n - 1).bit_length()
    low = half - 1
    end = list(range(1, n + 1))  # of the token that starts at i
    back = list(range(-1, n))  # the live position before i
    tree = [_NONE] * (2 * half)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            tree[half + i] = r * half + i
    for k in range(low, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    while (top := tree[1]) != _NONE:
        i = top & low
        j = end[i]
        e = end[i] = end[j]
        p = back[i]
        # the leaf of j is dead; those of i and of the live position before it are other pairs now
        changed = [(half + j, _NONE), (half + i, _NONE)]
        if e < n:
            back[e] = i
            if (r := rank(piece[i : end[e]])) is not None:
                changed[1] = (half + i, r * half + i)
        if p >= 0:
            changed.append((half + p, _NONE if (r := rank(piece[p:e])) is None else r * half + p))
        for k, value in changed:
            if tree[k] != value:
                tree[k] = value
                while k > 1:
                    beside = tree[k ^ 1]
                    if beside < value:
                        value = beside
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairTable:
    """Ranks of token pairs, for arrays of ids: an open-addressing table of the pairs that make a token."""

    SIZE_BITS = 20
    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(x << 32) | y: r for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None}
        self.bits = max(self.SIZE_BITS, (2 * len(pairs)).bit_length())
        keys, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.keys, self.values = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits, np.int64)
        at = self._slot(keys)
        while len(keys):  # of the pairs that want a free slot one gets it; the others go on to the next
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)
        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        seen = self.keys[at]
        hit = np.flatnonzero(seen == keys)
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero((seen != keys) & (seen != self.EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen, want = self.keys[at[left]], keys[left]
            hit = left[seen == want]
            out[hit] = self.values[at[hit]]
            left = left[(seen != want) & (seen != self.EMPTY)]
        return out


def merge_many(raw: np.ndarray, size: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids that merge() gives for pieces, the first size bytes of raw's rows, as wide as a power of two, and how many each has. All trees lie side by
    side: level[k] holds level k of every tree, from the leaves up."""
    m, half = raw.shape
    low, shift = half - 1, half.bit_length() - 1
    ids = table.bytes[raw]
    following, back = np.tile(np.arange(1, half + 1), (m, 1)), np.tile(np.arange(-1, half), (m, 1))
    level = [np.full((m, half), _NONE, np.int64)]
    r, c = np.nonzero(np.arange(1, half + 1)[None] < size[:, None])
    found = table.find(ids[r, c], ids[r, c + 1])
    level[0][r, c] = np.where(found < 0, _NONE, (found << shift) | c)
    for _ in range(shift):
        level.append(np.minimum(level[-1][:, ::2], level[-1][:, 1::2]))
    rows = np.flatnonzero(level[-1][:, 0] != _NONE)
    while len(rows):
        top = level[-1][rows, 0]
        i = top & low
        j = following[rows, i]
        e = following[rows, j]
        rank = top >> shift
        ids[rows, i], following[rows, i] = rank, e
        level[0][rows, j] = level[0][rows, i] = _NONE
        more = np.flatnonzero(e < size[rows])
        q, at = rows[more], e[more]
        back[q, at] = i[more]
        found = table.find(rank[more], ids[q, at])
        level[0][q, i[more]] = np.where(found < 0, _NONE, (found << shift) | i[more])
        p = back[rows, i]
        before = np.flatnonzero(p >= 0)
        q, at = rows[before], p[before]
        found = table.find(ids[q, at], rank[before])
        level[0][q, at] = np.where(found < 0, _NONE, (found << shift) | at)
        # the three paths to the root
        r, c = np.concatenate([rows, rows, q]), np.concatenate([i, j, at])
        for k in range(shift):
            c = c >> 1
            level[k + 1][r, c] = np.minimum(level[k][r, 2 * c], level[k][r, 2 * c + 1])
        rows = rows[level[-1][rows, 0] != _NONE]
    live = np.zeros((m, half + 1), bool)
    at, r = np.zeros(m, np.int64), np.arange(m)
    while len(r):  # walk the live positions
        live[r, at] = True
        at = following[r, at]
        on = at < size[r]
        r, at = r[on], at[on]
    return ids[live[:, :half]], live.sum(axis=1)


class _Pieces:
    """The ids of pieces seen lately: those of piece i are ids[at[i] : at[i + 1]], and place has the short pieces' i."""

    def __init__(self, ranks: dict[bytes, int], tokens: pa.Array):
        self.ranks, self.tokens, self.table = ranks, tokens, PairTable(ranks)
        self.place: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1024, np.int32), np.zeros(1024, np.int64)

    def _append(self, ids: np.ndarray, at: np.ndarray) -> None:
        n = len(self.place)
        end = self.at[n]
        if len(self.at) < n + len(at):
            self.at = np.resize(self.at, 2 * (n + len(at)))
        if len(self.ids) < end + len(ids):
            self.ids = np.resize(self.ids, 2 * (end + len(ids)))
        self.at[n : n + len(at)], self.ids[end : end + len(ids)] = end + at, ids

    def number(self, pieces: pa.Array) -> np.ndarray:
        """The i of each of the distinct pieces, for as long as no others are asked for."""
        names = pieces.to_pylist()
        if len(self.place) >= CACHED:  # starts again with those that are in use
            old = [i for name in names if (i := self.place.get(name)) is not None]
            counts = self.at[1:][old] - self.at[old]
            ids = self.ids[_runs(self.at[old], counts)]
            self.place = {name: i for i, name in enumerate(filter(self.place.__contains__, names))}
            self.at[: len(old) + 1], self.ids[: len(ids)] = _bounds(counts), ids
        out = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            long = np.diff(_raw(pieces)[1])[new] > CACHED_BYTES
            new = new[np.argsort(long, kind="stable")]  # long ones come last and are written over next time
            n = len(self.place)
            out[new] = n + np.arange(len(new))
            self._append(*self._merged(pieces.take(pa.array(new))))
            self.place.update(zip(map(names.__getitem__, new[: len(new) - long.sum()].tolist()), count(n)))
        return out

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Merges pieces, short ones side by side. A piece that is a token is that token."""
        data, begins = _raw(pieces)
        sizes = np.diff(begins)
        whole = pc.fill_null(pc.index_in(pieces, self.tokens), -1).to_numpy()
        done = np.flatnonzero(whole >= 0)
        parts = [(done, whole[done], np.ones(len(done), np.int64))]
        left = whole < 0
        for row in np.flatnonzero(left & (sizes > SIDE_BY_SIDE)):
            ids = merge(data[begins[row] : begins[row + 1]].tobytes(), self.ranks)
            parts.append((np.array([row]), np.array(ids), np.array([len(ids)])))
        half, least = 4, 0
        while least < SIDE_BY_SIDE:
            rows = np.flatnonzero(left & (sizes > least) & (sizes <= half))
            for k in range(0, len(rows), MANY):
                part = rows[k : k + MANY]
                raw = data[np.minimum(begins[part][:, None] + np.arange(half), len(data) - 1)]
                parts.append((part, *merge_many(raw, sizes[part], self.table)))
            half, least = 2 * half, half
        counts = np.zeros(len(pieces), np.int64)
        for rows, _, n in parts:
            counts[rows] = n
        at = _bounds(counts)
        out = np.empty(at[-1], np.int32)
        for rows, ids, n in parts:
            out[_runs(at[rows], n)] = ids
        return out, at


class Codec:
    """Encoder and decoder for one rank table (base64 token, space, rank; a line each) and one pattern that splits texts."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_lines.splitlines() if line)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the rank table lacks {len(missing)} single bytes")
        self.split = splitter(pattern)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d," % r for r in range(len(tokens))], pa.large_binary())
        self.pieces = _Pieces(self.ranks, self.tokens)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and where each text's begin and the last one's end. A piece that occurs in any of them is merged once."""
        pieces, bounds = self.split(texts)
        coded = pieces.dictionary_encode()
        which = self.pieces.number(coded.dictionary)[coded.indices.to_numpy()]
        first = self.pieces.at[which]
        counts = self.pieces.at[which + 1] - first
        return self.pieces.ids[_runs(first, counts)], _bounds(counts)[bounds]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids, which are given as encode_all() gives them, one after the other, and where each begins and the last one ends."""
        return _listed(self.tokens, ids, ends)

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int32), np.array([0, len(ids)]))[0].tobytes()


def _listed(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of ids, one after the other, and the places in them that the places ends in ids become."""
    data, at = _raw(names.take(pa.array(ids)))
    return data, at[ends]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(lines, pattern)
    return _codecs[key]


class Vocabulary:
    """A rank file and its pattern. The file, whose size is that of a vocabulary, is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.lines = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def codec(self) -> Codec:
        return _codec(self.lines.value, self.pattern)

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "pattern": self.pattern}


def default_vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def _slices(column: pa.Array) -> Iterator[slice]:
    """Rows whose texts, or lists of ids, have SLICE_BYTES together, or one row that has more."""
    lengths = pc.binary_length(column) if not pa.types.is_list(column.type) else pc.list_value_length(column)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield slice(a, b)
        a = b


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for rows in _slices(batch.column(text_col)):
                ids, ends = codec.encode_all(batch.column(text_col)[rows])
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[rows], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary) from (id, ids); null ids are none."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for rows in _slices(batch.column("ids")):
                lists = batch.column("ids")[rows]
                ends = _bounds(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[rows], _binary(*codec.decode_all(lists.flatten().to_numpy(), ends)).cast(pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, bytes binary")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encodes and decodes every text in one pass and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = vocabulary.codec(), hashlib.sha256
        for batch in batches:
            for rows in _slices(batch.column("text")):
                texts = batch.column("text")[rows]
                ids, ends = codec.encode_all(texts)
                back, at = codec.decode_all(ids, ends)
                listed, to = _listed(codec.decimals, ids, ends)
                data, own = _raw(texts)
                ids_sha = [sha(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(to[:-1], to[1:])]
                text_sha = [sha(back[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                same = [np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(at[:-1], at[1:], own[:-1], own[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary(spark))
