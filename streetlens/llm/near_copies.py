"""Near copies by Jaccard similarity of word shingles.

Texts are linked where their sets of 5-word shingles have a similarity of 0.8 or more.
Equal sets are one node. Candidates are sets whose SimHash fingerprints BK-trees find
within two bits, and sets that share a band of minhashes: 20 bands of 5 rows, by which a
pair at 0.8 is met with a chance of 0.9996, and more alike ones more surely. Fingerprints
alone cannot serve: texts at 0.8 differ in up to about a dozen bits, for which shards of
common bytes do not exist. Every link is checked on the whole sets. The likeliest pairs
are checked first, and pairs inside a component need no check, so that a large group
costs about its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm import simhash
from streetlens.llm.common import checkpointed, map_slices, small_batches
from streetlens.llm.components import connected
from streetlens.sources.session import collected, staged

WORDS = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
SEED = 43
#: Shingles whose minhashes are taken at a time.
COUNTED = 1 << 12
#: Up to so many members of a band all pairs are candidates; of more, each with the
#: smallest and with so many next ones in the order of the next band.
ALL_PAIRS, NEXT = 16, 4
#: Members of a band that one window holds.
RUN = 1 << 16
#: Members of a large band that one task meets with those of other components.
MEET = 1 << 10
#: Members outside of the largest component that one task holds, and pairs that it compares at a time.
OUTSIDE, COMPARED = 1 << 13, 1 << 14
#: Counters of a sketch, a byte each.
COUNTERS = 512
#: Rounds in which a component's likeliest pair alone is checked, before all others.
ROUNDS = 2

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[words - 1 :] or ends[-1:], strict=False)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def bands(own: np.ndarray) -> bytes:
    """A hash of each band, 8 bytes each; nothing for the empty set."""
    import xxhash

    if not len(own):
        return b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), COUNTED):
        least = np.minimum(least, (own[i : i + COUNTED] * _FACTORS).min(axis=1))
    raw = least.tobytes()
    return b"".join(xxhash.xxh64_digest(raw[b * ROWS * 8 : (b + 1) * ROWS * 8], b) for b in range(BANDS))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def _sets(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, set_key, bands, fingerprint and number of shingles of every row."""
    import xxhash

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))

    def per_slice():
        def run(batch: pa.RecordBatch) -> dict:
            own = [shingles(t) for t in batch.column(1).to_pylist()]
            keys = b"".join(xxhash.xxh64_digest(s.tobytes(), SEED) for s in own)
            bits = b"".join(simhash.majority((s[i : i + COUNTED].astype(">u8").tobytes() for i in range(0, len(s), COUNTED)), len(s)) for s in own)
            return {"doc_id": batch.column(0), "text_key": batch.column(2), "set_key": pa.array(np.frombuffer(keys, "<i8")), "bands": list(map(bands, own)), "fp": pa.array(np.frombuffer(bits, ">i8").astype("<i8")), "shingles": pa.array(list(map(len, own)), pa.int32())}

        return run

    return map_slices(rows, per_slice, "doc_id long, text_key long, set_key long, bands binary, fp long, shingles int")


def _members(sets: DataFrame, *also: str) -> DataFrame:
    """The members of each band i: i, band, next (its next band) and set_key."""
    at = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    band = lambda i: F.expr(f"conv(hex(substring(bands, ({i}) * 8 + 1, 8)), 16, -10)").cast("long")
    return sets.where("length(bands) > 0").select("set_key", "bands", *also, at.alias("i")).select("i", band("i").alias("band"), band(f"(i + 1) % {BANDS}").alias("next"), "set_key", *also)


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs u > v of set keys that share bands or have near fingerprints, and how many
    bands; near fingerprints count as all of them.

    Of a band that few sets have, all pairs; of one that many have, each with the smallest
    and with the next ones in the order of the next band; missed() has the others, once
    components are known. Members are counted first; many
    are dealt over runs by a hash, which the smallest connects, so that no task holds or
    sorts a whole group."""
    members = _members(sets)
    groups = members.groupBy("i", "band").agg(F.count(F.lit(1)).alias("size"), F.min("set_key").alias("hub")).where("size > 1")
    met = members.join(groups, ["i", "band"]).withColumn("run", F.when(F.col("size") > RUN, F.pmod(F.xxhash64("set_key"), F.ceil(F.col("size") / RUN))).otherwise(0).cast("int"))
    order = Window.partitionBy("i", "band", "run").orderBy("next", "set_key")
    reach = F.when(F.col("size") <= ALL_PAIRS, F.lit(ALL_PAIRS)).otherwise(F.lit(NEXT))
    following = met.withColumn("following", F.collect_list("set_key").over(order.rowsBetween(1, ALL_PAIRS - 1))).withColumn("following", F.slice("following", F.lit(1), reach))
    others = F.when(F.col("size") > ALL_PAIRS, F.array_append("following", F.col("hub"))).otherwise(F.col("following"))
    pairs = following.select("set_key", F.explode(others).alias("other")).where("set_key != other").withColumn("n", F.lit(1)).unionByName(near_fingerprints(sets).withColumn("n", F.lit(BANDS)))
    return pairs.groupBy(F.greatest("set_key", "other").alias("u"), F.least("set_key", "other").alias("v")).agg(F.sum("n").alias("n"))


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall to each counter; nothing where one has too many for a byte."""
    counts = np.bincount((own % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _sketches(texts: DataFrame) -> DataFrame:
    def per_slice():
        return lambda batch: {"set_key": batch.column(0), "sketch": pa.array([sketch(shingles(t)) for t in batch.column(1).to_pylist()], pa.binary())}

    return map_slices(texts.select("set_key", "text"), per_slice, "set_key long, sketch binary")


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, i, a, b) whose sketches a, b allow the similarity: two sets have no more
    shingles in common than the smaller counts together, so that no link is lost."""
    for batch in batches:
        a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        keep = np.ones(batch.num_rows, bool)
        both = np.array([k for k in range(batch.num_rows) if a[k] and b[k]], np.int64)
        if len(both):
            x, y = (np.frombuffer(b"".join(c[k] for k in both), np.uint8).reshape(-1, COUNTERS) for c in (a, b))
            common, total = np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            keep[both] = common * LEAST[1] >= LEAST[0] * (total - common)
        yield batch.select([0, 1, 2]).filter(pa.array(keep))


def _meeting(every: pa.Table, outside: pa.Table) -> pa.Table:
    """Pairs u > v of two sides (i, set_key, root, shingles, sketch) in different components
    whose numbers of shingles and sketches allow the similarity. They are compared some at
    a time, so that those ruled out are never rows."""
    outside = outside.rename_columns([c.removeprefix("other_") for c in outside.column_names])
    (key, root, size), (other, other_root, other_size) = ([t[c].to_numpy().astype(np.int64) for c in ("set_key", "root", "shingles")] for t in (every, outside))
    found = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32())], names=["u", "v", "i"])]
    if len(key) and len(other):
        i, (x, y) = every["i"][0].as_py(), (t["sketch"].combine_chunks() for t in (every, outside))
        at_once = max(1, COMPARED // len(key))
        for start in range(0, len(other), at_once):
            part = slice(start, start + at_once)
            alike = np.minimum.outer(size, other_size[part]) * LEAST[1] >= np.maximum.outer(size, other_size[part]) * LEAST[0]
            a, b = np.nonzero(alike & (root[:, None] != other_root[None, part]))
            u, v = key[a], other[b + start]
            if len(a):
                columns = [pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(np.full(len(a), i), pa.int32()), x.take(pa.array(a)), y.take(pa.array(b + start))]
                found += _possible(iter([pa.RecordBatch.from_arrays(columns, names=["u", "v", "i", "a", "b"])]))
    return pa.Table.from_batches(found)


def missed(sets: DataFrame, stars: DataFrame, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The rest of candidates(), exactly: all pairs u > v of a band with many members that
    are no pair yet, are in different components (stars: u, v), and have numbers of
    shingles that allow the similarity; and n, how many such bands.

    texts (set_key, text): pairs that sketches of them rule out are left out, too.
    Of a group of copies nothing is left. Elsewhere the members outside of a band's largest
    component meet all members, which are dealt over tasks."""
    rooted = sets.select("set_key", "bands", "shingles").join(stars.withColumnRenamed("u", "set_key"), "set_key", "left").withColumn("root", F.coalesce("v", "set_key")).drop("v")
    members = _members(rooted, "root", "shingles").drop("next")
    parts = members.groupBy("i", "band", "root").agg(F.count(F.lit(1)).alias("part"))
    split = parts.groupBy("i", "band").agg(F.sum("part").alias("size"), F.max(F.struct("part", "root")).alias("most"), F.count(F.lit(1)).alias("parts"))
    split = split.where(f"size > {ALL_PAIRS} and parts > 1").select("i", "band", F.col("most.root").alias("largest"), F.ceil(F.col("size") / MEET).cast("int").alias("tasks"), F.ceil((F.col("size") - F.col("most.part")) / OUTSIDE).cast("int").alias("runs"))
    met = members.join(split, ["i", "band"])
    met = met.withColumn("sketch", F.lit(b"")) if texts is None else met.join(_sketches(texts), "set_key")
    dealt = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = met.withColumn("task", dealt("tasks")).withColumn("run", all_of("runs"))
    outside = met.where("root != largest").withColumn("run", dealt("runs")).withColumn("task", all_of("tasks"))
    cell = ["i", "band", "task", "run"]
    columns = [*cell, "set_key", "root", "shingles", "sketch"]
    # names of its own, since both sides are made of the same rows
    others = outside.select(*[F.col(c).alias(f"other_{c}") for c in columns]).groupBy(*[f"other_{c}" for c in cell])
    found = every.select(*columns).groupBy(*cell).cogroup(others).applyInArrow(_meeting, "u long, v long, i int")
    new = found.distinct().groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return new.join(pairs.select("u", "v"), ["u", "v"], "left_anti")


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """Spanning pairs (set_key, other) of sets whose fingerprints BK-trees link."""
    some = sets.where("length(bands) > 0")
    first = checkpointed(some.groupBy("fp").agg(F.min("set_key").alias("hub")))
    same = some.select("fp", "set_key").join(first, "fp").where("set_key != hub").select("set_key", F.col("hub").alias("other"))
    of = lambda key, name: first.select(F.col("fp").alias(key), F.col("hub").alias(name))
    near = simhash.near_links(first.select("fp")).distinct().join(of("u", "set_key"), "u").join(of("v", "other"), "v").select("set_key", "other")
    return same.unionByName(near)


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar. texts: set_key, text."""
    small_batches(pairs.sparkSession)
    of = lambda key, name: texts.select(F.col("set_key").alias(key), F.col("text").alias(name))
    both = pairs.select("u", "v").join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(maxsize=16)(shingles)
        for batch in batches:
            keep = pa.array([similar(own(a.as_py()), own(b.as_py())) for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return both.mapInArrow(run, "u long, v long")


def _between(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs (u, v, n) of different components, with those (cu, cv)."""
    of = lambda key, name: stars.select(F.col("u").alias(key), F.col("v").alias(name))
    rooted = pairs.join(of("u", "ru"), "u", "left").join(of("v", "rv"), "v", "left")
    return rooted.select("u", "v", "n", F.coalesce("ru", "u").alias("cu"), F.coalesce("rv", "v").alias("cv")).where("cu != cv")


def _likeliest(left: DataFrame) -> DataFrame:
    """Of pairs (u, v, n, cu, cv) those (u, v) that are the likeliest of a component. Each end
    is summed up by itself, so that a pair makes no rows."""
    ends = [left.groupBy(F.col(c).alias("c")).agg(F.max(F.struct("n", "u", "v")).alias("best")) for c in ("cu", "cv")]
    return ends[0].unionByName(ends[1]).groupBy("c").agg(F.max("best").alias("best")).select("best.u", "best.v").distinct()


def _links(pairs: DataFrame, texts: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """Stars (u, v) of the sets that similar pairs form, and stars found before."""
    left = pairs.withColumns({"cu": F.col("u"), "cv": F.col("v")}) if stars is None else checkpointed(_between(pairs, stars))
    for k in range(ROUNDS + 1):
        chosen = left.select("u", "v")
        if k < ROUNDS:
            chosen = _likeliest(left)
        chosen = checkpointed(chosen)
        new = checkpointed(checked(chosen, texts))
        stars = connected(new if stars is None else stars.union(new))
        if k < ROUNDS:
            left = checkpointed(_between(left.select("u", "v", "n").join(chosen, ["u", "v"], "left_anti"), stars))
        new = None
        collected(pairs.sparkSession)
    return stars


def deduplicate(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each set of linked texts: the one with the smallest doc_id.

    Null, empty and white texts are alike; texts of fewer words than a shingle are one
    shingle; very long texts are hashed in runs; of rows that repeat the smallest id the
    one with the smallest hash of its text stays; a null doc_id stays only where its set
    has no other; an empty table gives no rows; other columns go along, whatever their
    names."""
    collected(df.sparkSession)
    rows = checkpointed(_sets(df, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    sets = checkpointed(rows.groupBy("set_key").agg(first, F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles")))
    del rows
    pairs = checkpointed(candidates(sets))
    collected(df.sparkSession)
    met = pairs.select(F.explode(F.array("u", "v")).alias("set_key")).distinct()
    # a table has a size that Spark knows: it is broadcast under spark.sql.autoBroadcastJoinThreshold, and beyond it texts are shuffled
    wanted = staged(sets.join(met, "set_key").select("set_key", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key")))
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    texts = checkpointed(texts.join(wanted, (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id"))).select("set_key", "text").dropDuplicates(["set_key"]))
    collected(df.sparkSession)
    stars = _links(pairs, texts)
    rest = checkpointed(missed(sets, stars, pairs, texts))
    collected(df.sparkSession)
    if not rest.isEmpty():
        stars = _links(rest, texts, stars)
    labelled = sets.join(stars.withColumnRenamed("u", "set_key"), "set_key", "left").select("first", F.coalesce("v", "set_key").alias("root"))
    kept = labelled.groupBy("root").agg(F.min("first").alias("kept")).select("kept.doc_id", "kept.text_key")
    return simhash.only(df, kept, doc_id=doc_id, text=text)
