"""Byte-level BPE encoding by overlapping chunks, and decoding.

The split pattern looks ahead but never back, so two splits of a text that share a
boundary agree from there on. A text longer than a chunk is cut into chunks that
overlap; the chunks are split into pre-tokens apart from each other, over all tasks;
a text's chunks then meet (a task holds one text at a time, which one row held
before), and each boundary list is followed until it meets one of the next chunk's
list. If the overlap has no common boundary (one very long pre-token), splitting goes
on from the last sure boundary until one is met, so the result is exact for any text.
A text of one chunk has nothing to stitch. Pieces are encoded by themselves, pairs of
least rank merged first, new pieces of some texts at once as arrays; frequent pieces come
from a bounded table. Decoding
concatenates the bytes of the ids.

Ids are packed as little-endian unsigned 32-bit integers in a binary column
(``numpy.frombuffer(ids, "<u4")``): a list column would cost as much again to move.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import map_slices, shuffle_partitions, slices, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
#: Pieces remembered in a Python worker; the table starts anew when full. Those of the texts
#: that are encoded together are in it while they are.
REMEMBERED = 1 << 17
#: The pattern's longest alternative that looks at a fixed text is three characters.
LOOK_AHEAD = 3
#: The last code point of the basic plane, and a character behind it.
BASIC = 0xFFFF
_BEHIND = re.compile("[\U00010000-\U0010ffff]")

#: More than any rank.
NO_PAIR = 1 << 40
#: Pieces of texts that are looked up together, but for those of one text.
TOGETHER = 1 << 16
#: Pieces up to so many bytes are merged together, many at a time.
SHORT_BYTES = 32

_CODECS: dict[tuple[str, str], Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Pieces(dict):
    """Piece to packed ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64 and len(self) < REMEMBERED:
            self[piece] = packed
        return packed


class Pairs:
    """The ranks of pairs of tokens, for arrays of them: a table with open addresses."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), NO_PAIR, np.int64)
        todo = np.array(keys, np.int64)
        rank = np.array(values, np.int64)
        at = self._place(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == -1)
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = todo[free[first]], rank[free[first]]
            left = self.keys[at] != todo
            todo, rank, at = todo[left], rank[left], (at[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NO_PAIR where there is none."""
        keys = left << 32 | right
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NO_PAIR)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            met = there == keys[todo]
            out[todo[met]] = self.values[at[todo[met]]]
            todo = todo[~met & (there != -1)]
        return out


def merge_many(pieces: list[bytes], ones: np.ndarray, pairs: Pairs) -> list[bytes]:
    """merge() of pieces of two bytes at least, all at once, as packed ids. ones: the ranks
    of single bytes.

    From the longest down: pieces of as many parts are rows of an array, of which each one
    that still has a pair merges its pair of least rank, the first of equal ones, and is a
    row of the next array, a part shorter."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(int(lengths.max(initial=0)) + 2))
    who, parts, rank = np.empty(0, np.int64), None, None
    for n in range(len(ends) - 2, 0, -1):
        new = order[ends[n] : ends[n + 1]]
        if len(new):
            fresh = ones[np.frombuffer(b"".join([pieces[i] for i in new.tolist()]), np.uint8)].reshape(len(new), n)
            ranks = pairs.ranks(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(len(new), n - 1)
            who, parts, rank = (np.concatenate([who, new]), np.concatenate([parts, fresh]), np.concatenate([rank, ranks])) if len(who) else (new, fresh, ranks)
        if not len(who):
            continue
        row = np.arange(len(who))
        at = rank.argmin(1) if n > 1 else np.zeros(len(who), np.int64)
        least = rank[row, at] if n > 1 else np.full(len(who), NO_PAIR)
        over = least == NO_PAIR
        packed = parts[over].astype("<u4").tobytes()
        for k, i in enumerate(who[over].tolist()):
            out[i] = packed[4 * n * k : 4 * n * (k + 1)]
        who, at, least, parts, rank = who[~over], at[~over], least[~over], parts[~over], rank[~over]
        if not len(who):
            continue
        row = np.arange(len(who))
        parts[row, at] = least
        kept = np.ones(parts.shape, bool)
        kept[row, at + 1] = False
        parts = parts[kept].reshape(len(who), n - 1)
        kept = np.ones(rank.shape, bool)
        kept[row, at] = False
        rank = rank[kept].reshape(len(who), n - 2)
        right = np.flatnonzero(at < n - 2)
        rank[right, at[right]] = pairs.ranks(least[right], parts[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = pairs.ranks(parts[left, at[left] - 1], least[left])
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: of all neighbours, the pair of least rank becomes one part, the
    first of equal ones, until no pair has a rank.

    A part is known by its start; a heap holds rank and start of each pair in one number,
    and a pair counts while its rank is still that of its start."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 2))  # start of the part behind, n at the end
    before = list(range(-1, n))
    pair = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    todo = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
    heapify(todo)
    while todo:
        least = heappop(todo)
        at = least & 0xFFFFFFFFFF
        if pair[at] != least >> 40:
            continue
        gone = after[at]
        end = after[at] = after[gone]
        pair[gone] = -1
        if end < n:
            before[end] = at
            r = pair[at] = ranks.get(piece[at : after[end]], -1)
            if r >= 0:
                heappush(todo, r << 40 | at)
        else:
            pair[at] = -1
        left = before[at]
        if left >= 0:
            r = pair[left] = ranks.get(piece[left:end], -1)
            if r >= 0:
                heappush(todo, r << 40 | left)
    out = []
    at = 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.split = re.compile(_python_pattern(pattern))
        # Python looks up classes of the basic plane in a table, but tries ranges behind it one by one
        self.basic_split = re.compile(_python_pattern(pattern, BASIC))
        self.pieces = _Pieces(lambda piece: merge(piece, ranks))
        self.ranks = ranks
        self.ones = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.pairs = Pairs(ranks)

    def split_of(self, text: str) -> re.Pattern:
        """The split for a text: ranges that none of its characters can be in are left out."""
        return self.split if not text.isascii() and _BEHIND.search(text) else self.basic_split

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces, those that are not remembered yet merged together."""
        if self.ones.min() < 0:
            return  # merge() tells of bytes without a rank
        new = pieces.difference(self.pieces)
        if len(self.pieces) + len(new) > REMEMBERED:
            self.pieces.clear()
            new = pieces
        names, short = [], []
        for piece in new:
            coded = piece.encode()
            whole = self.ranks.get(coded)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(coded) <= SHORT_BYTES:
                names.append(piece)
                short.append(coded)
        self.pieces.update(zip(names, merge_many(short, self.ones, self.pairs), strict=True))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the pieces of some texts at a time."""
        out: list[bytes] = []
        some: list[list[str]] = []
        number = 0
        for text in texts:
            some.append(self.split_of(text).findall(text))
            number += len(some[-1])
            if number >= TOGETHER:
                out += self._encoded(some)
                some, number = [], 0
        return out + self._encoded(some)

    def encode_long(self, pieces: list[str]) -> bytes:
        """The ids of a text's pieces, some of them at a time."""
        return b"".join(self._encoded([pieces[at : at + TOGETHER]])[0] for at in range(0, len(pieces), TOGETHER))

    def _encoded(self, texts: list[list[str]]) -> list[bytes]:
        self.learn(set().union(*texts))
        return [self.encode_pieces(pieces) for pieces in texts]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache
def _ranges(escape: str) -> list[tuple[int, int]]:
    """Ranges of a class in the tokenizer library's Unicode tables."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    codes = np.frombuffer(one.decode_bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(np.diff(codes) != 1)
    first, last = codes[np.r_[0, ends + 1]], codes[np.r_[ends, len(codes) - 1]]
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _class_of(escape: str, top: int) -> str:
    """A class for Python's re, up to a code point."""
    return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in _ranges(escape) if a <= top)


def _python_pattern(pattern: str, top: int = 0x10FFFF) -> str:
    """The pattern with its classes written out, as the library's own tables have them."""
    for escape in (r"\p{L}", r"\p{N}", r"\s"):
        members = _class_of(escape, top)
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(escape), lambda m, members=members: m[1] + members, pattern)
        pattern = pattern.replace(escape, f"[{members}]")
    members = _class_of(r"\s", top)
    return pattern.replace(r"\S", f"[^{members}]")


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of this process, loaded once."""
    import public_tokenizers

    key = (path or default_path(), pattern or public_tokenizers.PATTERN)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def chunk_boundaries(split: re.Pattern, chunk: str, offset: int, last: bool) -> list[int]:
    """Starts and the end of the sure pre-tokens of a chunk, from the whole text's start.
    What ends near the end of a chunk that is not the last may go on behind it."""
    ends = [m.end() for m in split.finditer(chunk)]
    if not last:
        sure = len(chunk) - LOOK_AHEAD
        while ends and ends[-1] > sure:
            ends.pop()
    return [offset, *(e + offset for e in ends)]


def stitch(split: re.Pattern, text: str, boundaries: list[list[int]], chunk_chars: int) -> list[int]:
    """The boundaries of the whole text's pre-tokens from those of its chunks."""
    known = [set(b) for b in boundaries]
    out = [0]
    i = 0
    while True:
        if i == len(boundaries) - 1:
            out += [b for b in boundaries[i] if b > out[-1]]
            return out
        met = None
        for b in boundaries[i]:
            if b > out[-1]:
                out.append(b)
            if b >= (i + 1) * chunk_chars and b == out[-1]:
                at = min(b // chunk_chars, len(known) - 1)
                if at > i and b in known[at]:
                    met = at
                    break
        if met is None:
            for m in split.finditer(text, out[-1]):
                out.append(m.end())
                at = min(m.end() // chunk_chars, len(known) - 1)
                if at > i and m.end() in known[at]:
                    met = at
                    break
        if met is None:
            return out
        i = met


def encode(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: bool = False,
) -> DataFrame:
    """Token ids of every whole text.

    Null and empty texts have no ids; a very long text is cut in one pass and spread over
    tasks; repeated rows stay repeated; pairs of equal rank merge from the left; an empty
    table gives no rows; other columns are left out. Texts are ordinary text, whatever
    special tokens they spell. With `decoded`, the ids are decoded again as well.
    Returns doc_id, n_tokens, ids (packed), and decoded (binary) if asked for."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded

    def per_slice():
        own = codec(path, pattern)

        def encode_slice(batch: pa.RecordBatch) -> dict:
            ids = own.encode_texts(batch.column(1).to_pylist())
            out = {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return out | ({"decoded": [own.decode(x) for x in ids]} if decoded else {})

        return encode_slice

    short = map_slices(rows.where(F.length("text") <= chunk_chars), per_slice, schema)

    # rows that are equal are one, with their number
    whole = rows.where(F.length("text") > chunk_chars).groupBy("doc_id", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def cut(batches):
        for batch in batches:
            for i in range(len(batch)):
                number, key, copies = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                body = batch.column(2)[i].as_py()
                of = -(-len(body) // chunk_chars)
                parts = [body[at : at + chunk_chars + overlap_chars] for at in range(0, len(body), chunk_chars)]
                same = lambda x, kind: pa.array([x] * of, kind)
                yield pa.RecordBatch.from_arrays(
                    [same(number, pa.int64()), pa.array(parts, pa.string()), same(key, pa.string()), same(copies, pa.int64()), same(of, pa.int32()), pa.array(range(of), pa.int32())],
                    names=["doc_id", "text", "key", "copies", "of", "chunk"],
                )

    small_batches(df.sparkSession)
    chunks = whole.select("doc_id", "key", "text", "copies").mapInArrow(cut, "doc_id long, text string, key string, copies long, of int, chunk int")
    chunks = chunks.repartition(shuffle_partitions(df.sparkSession), "key", "doc_id", "chunk")

    def split_chunks(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part in slices([batch]):
                at = zip(part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)
                found = [np.array(chunk_boundaries(own.split_of(t), t, i * chunk_chars, i == of - 1), "<i4").tobytes() for t, of, i in at]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=["doc_id", "text", "key", "copies", "of", "chunk", "boundaries"])

    split_up = chunks.mapInArrow(split_chunks, "doc_id long, text string, key string, copies long, of int, chunk int, boundaries binary")

    def join_chunks(group: pa.Table) -> pa.Table:
        own = codec(path, pattern)
        rows_in = sorted(zip(group["chunk"].to_pylist(), group["text"].to_pylist(), group["boundaries"].to_pylist(), strict=True), key=lambda r: r[0])
        whole = "".join(t[:chunk_chars] for _, t, _ in rows_in[:-1]) + rows_in[-1][1]
        ends = stitch(own.split_of(whole), whole, [np.frombuffer(b, "<i4").tolist() for _, _, b in rows_in], chunk_chars)
        ids = own.encode_long([whole[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        columns = [pa.array([group["doc_id"][0].as_py()], pa.int64()), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())]
        if decoded:
            columns.append(pa.array([own.decode(ids)], pa.binary()))
        return pa.table([*columns, group["copies"][:1]], names=[*["doc_id", "n_tokens", "ids", "decoded"][: 3 + decoded], "copies"])

    long = split_up.groupBy("doc_id", "key").applyInArrow(join_chunks, f"{schema}, copies long")
    long = long.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return short.unionByName(long)


def decode(df: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The bytes of packed ids; null ids give no bytes. Returns doc_id, decoded."""

    def per_slice():
        own = codec(path, pattern)
        return lambda batch: {"doc_id": batch.column(0), "decoded": [own.decode(x or b"") for x in batch.column(1).to_pylist()]}

    return map_slices(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")), per_slice, "doc_id long, decoded binary")
