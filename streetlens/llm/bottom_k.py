"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's word shingles, in
order. Sketches merge by keeping the k smallest of both, so parts of a document (or
of a corpus) may be sketched apart. Two sketches estimate resemblance (Jaccard) and
containment of the shingle sets, one sketch the number of distinct shingles; while a
set has under k shingles all of these are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.common import SLICE_CHARS, shuffle_partitions, slices, small_batches

K = 128
WORDS = 5
SEED = 9
#: Word hashes remembered in a Python worker; the table starts anew when full.
REMEMBERED = 1 << 18
#: A range's own rows, and the first ones of the next range.
OWN, SENTINEL = 0, 1

EMPTY = np.zeros(0, np.uint64)
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_HASHES = _Words()


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """A hash for each run of `words` words (A-Z lowered, split at ASCII white space);
    one for the whole sequence if it is shorter; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return EMPTY
    own = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    span = min(words, len(own))
    n = len(own) - span + 1
    mixed = own[:n] * _MULTIPLIERS[0]
    for i in range(1, span):
        mixed ^= mixed >> np.uint64(29)
        mixed += own[i : i + n]
        mixed *= _MULTIPLIERS[i % len(_MULTIPLIERS)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    if len(hashes) > 8 * k:
        limit = np.uint64(int((1 << 64) * (3 * k / len(hashes))))
        low = np.unique(hashes[hashes < limit])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return bottom_k(shingle_hashes(text, words), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches have seen."""
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that is in both; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    distinct = np.flatnonzero(np.concatenate([[True], ~same]))
    if len(distinct) <= k:
        return float(same.sum()) / len(distinct)
    bound = both[distinct[k - 1]]
    return float((same & (both[1:] <= bound)).sum()) / k


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for a sketch that is not full."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, r * union / distinct_count(a, k))


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


class Ranges:
    """Ranges of rows in the order of descending id and then of a hash of the text, ids
    that are null last. An id that many rows have is cut by the hash."""

    def __init__(self, cut: list[int], nulls: int, hashes: int = 1 << 63):
        """cut: ids at equal shares of the rows, repeated where an id has more of them;
        nulls: bounds that fall on null ids."""
        span = lambda n: [-hashes + 2 * hashes * (i + 1) // (n + 1) for i in range(n)]
        self.ids = np.array(sorted(set(cut), reverse=True), np.int64)
        # an id is a bound itself, and once more for each further share that it has
        self.within = [np.array([-hashes, *span(cut.count(int(i)) - 1)], np.int64) for i in self.ids]
        self.null = np.array(([-hashes] if len(cut) else []) + span(nulls), np.int64)
        self.before = np.concatenate([[0], np.cumsum([len(w) for w in self.within], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.null) + 1

    def of(self, ids: np.ndarray, known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of bounds at or before each row."""
        larger = len(self.ids) - np.searchsorted(self.ids[::-1], ids, side="right")
        at = self.before[larger]
        at[~known] = self.before[-1] + np.searchsorted(self.null, hashes[~known], side="right")
        for i in np.flatnonzero(np.isin(self.ids, ids[known])):
            rows = known & (ids == self.ids[i])
            at[rows] += np.searchsorted(self.within[i], hashes[rows], side="right")
        return at


def with_next(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, kind, part) dealt by ranges of descending doc_id and a hash of
    the text, and sorted.

    The last row of a range needs the first one of the next range (of the last range,
    the first of all): rows like that one are sent there as well, as sentinels behind
    the range's own rows. Only ids and hashes are aggregated, and texts are shuffled once."""
    parts = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    shares = [i / parts for i in range(1, parts)]
    cut = F.percentile_approx("doc_id", shares, 10_000) if shares else F.lit(None)
    found = rows.agg(cut.alias("cut"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    nulls = round(parts * (found["n"] - found["known"]) / max(1, found["n"]))
    ranges = Ranges(list(found["cut"] or [])[:: max(1, parts // max(1, parts - nulls))], max(0, nulls - 1))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(), hashes.to_numpy(np.int64)).astype(np.int32))

    placed = rows.withColumn("part", part_of("doc_id", "h"))
    # the first row of each range: ~id ascends where id descends, and cannot overflow
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), F.col("h"))
    firsts = [(r["part"], r["first"]["none"], ~r["first"]["down"], r["first"]["h"]) for r in placed.select("part", order.alias("o")).groupBy("part").agg(F.min("o").alias("first")).collect()]
    firsts.sort()
    # of each range its first row's id and hash, and the range before it; the first follows the last
    ends = [(p, none, i, h, firsts[k - 1][0]) for k, (p, none, i, h) in enumerate(firsts)]
    entry = F.element_at(F.create_map(*[x for p, none, i, h, last in ends for x in (F.lit(p), F.struct(F.lit(none).alias("none"), F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("h"), F.lit(last).alias("last")))]), F.col("part")) if ends else None
    own = F.struct(F.lit(OWN).alias("kind"), F.col("part").alias("part"))
    places = F.array(own)
    if ends:
        is_first = (F.col("first.none") == F.col("doc_id").isNull()) & (F.col("first.none") | (F.col("first.id") == F.col("doc_id"))) & (F.col("first.h") == F.col("h"))
        places = F.when(is_first, F.array(own, F.struct(F.lit(SENTINEL).alias("kind"), F.col("first.last").alias("part")))).otherwise(places)
        placed = placed.withColumn("first", entry)
    return (
        placed.withColumn("place", F.explode(places)).select("doc_id", "text", "h", "place.kind", "place.part")
        .repartitionById(len(ranges), F.col("part"))
        .sortWithinPartitions("kind", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")
    )


def fingerprint_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """The sketch of every whole text, and of the text after an edit: its last third
    replaced by the start of the next document by descending doc_id (after the last
    the first; equal ids by a hash of the text; null ids last).

    Null texts are empty; an empty text has an empty sketch, like only to another
    empty one; very long texts are read in whole, one at a time; repeated rows follow
    each other; an empty table gives no rows; other
    columns are left out. Returns doc_id, n_chars, edited (text), sketch and
    edited_sketch (hex), near_edited, near_next, n_shingles, contained_edited."""
    small_batches(df.sparkSession)
    dealt = with_next(df, doc_id=doc_id, text=text)
    schema = "doc_id long, n_chars long, edited string, sketch string, edited_sketch string, near_edited double, near_next double, n_shingles double, contained_edited double"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(names, (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4), strict=True))
        previous = None
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[n]) for i, n in enumerate(names)], names=names)

        for batch in batches:
            for part in slices([batch]):
                for number, body, kind in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if kind == SENTINEL and previous is None:
                        continue
                    own = sketch(body, k, words)
                    if previous is not None:
                        of, was, its = previous
                        changed = edited(was, body)
                        new = sketch(changed, k, words)
                        out.append((of, len(was), changed, to_hex(its), to_hex(new), resemblance(its, new, k), resemblance(its, own, k), distinct_count(its, k), containment(its, new, k)))
                        held += len(changed) + 32 * k
                        if held > SLICE_CHARS:
                            yield flush()
                            out, held = [], 0
                    previous = (number, body, own) if kind == OWN else None
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)
