"""Language identification by bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its character n-grams; the filters share their
hash functions and are stored bit-sliced: one word for each position, whose bit l
belongs to language l. Reading an n-gram's positions and and-ing the words returns
all languages that contain it at once. A text's n-grams are counted by the word they
return; the counts of a language's bit (its popcount over the text) are corrected for
the filter's false positives, and the largest decides.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.common import given_back, id_crc, map_slices, small_batches

N = 4
HASHES = 3
#: Positions of the filters: 4 MB with up to eight languages.
POSITIONS = 1 << 22
#: The bound of the fit: so many labelled documents of each language are read at most,
#: out of those of at most so many characters: short and middling texts teach, long ones
#: are judged only.
TRAIN_DOCS, TRAIN_CHARS = 600, 40_000
#: An n-gram belongs to a language that has it at least this often next to the one that has it most often.
MIN_RATIO = 0.2
UNKNOWN = "und"
#: Characters of text that are judged at a time, so that arrays stay in the processor's cache.
RUN_CHARS = 400_000
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to its lower-case code point if it is a letter, else 32."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS = table
    return _LETTERS


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of whole texts, and the number of each one's text.
    Runs of other characters than letters count as one space; texts are padded."""
    pad = " " * (n - 1)
    joined = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + (n - 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate([np.zeros(n - 1, np.int64), owner])
    codes = _letters()[joined]
    letter = codes != 32
    starts = np.cumsum(lengths) - lengths
    # a space stays if a letter precedes it, or if it is padding
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for i in range(n - 1):
        keep[starts + i] = True
    keep[-(n - 1) :] = True
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    m = len(codes) - n + 1
    grams = codes[:m].copy()
    for i in range(1, n):
        grams *= np.uint64(0x100000001B3)
        grams += codes[i : i + m]
    # those that start in the padding behind a text or hold spaces only say nothing
    real = letter[keep]
    any_letter = real[:m].copy()
    for i in range(1, n):
        any_letter |= real[i : i + m]
    same = owner[:m] if n == 1 else owner[n - 1 :]
    return grams[any_letter], same[any_letter]


def long_ngrams(text: str, n: int = N, at_once: int | None = None) -> Iterator[np.ndarray]:
    """The n-grams of one text as `ngrams` has them, from runs of its characters: a run
    takes up the last n - 1 characters that count of the one before."""
    at_once = at_once or RUN_CHARS
    tail = np.full(n - 1, 32, np.uint32)
    after_letter = False
    for at in range(0, max(1, len(text)), at_once):
        codes = _letters()[np.frombuffer(text[at : at + at_once].encode("utf-32-le", "surrogatepass"), "<u4")]
        letter = codes != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(keep):
            keep[0] |= after_letter
            after_letter = bool(letter[-1])
        codes = np.concatenate([tail, codes[keep], np.full((n - 1) * (at + at_once >= len(text)), 32, np.uint32)])
        m = max(0, len(codes) - n + 1)
        grams, any_letter = codes[:m].astype(np.uint64), codes[:m] != 32
        for i in range(1, n):
            grams *= np.uint64(0x100000001B3)
            grams += codes[i : i + m]
            any_letter |= codes[i : i + m] != 32
        yield grams[any_letter]
        tail = codes[len(codes) - (n - 1) :]


def positions(grams: np.ndarray, size: int = POSITIONS) -> list[np.ndarray]:
    out = []
    for m in _MIX[:HASHES]:
        h = grams * m
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64))
    return out


@dataclasses.dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def fit(texts: dict[str, list[str]], size: int = POSITIONS) -> Filters:
        """From whole texts of each language; at most 64 languages."""
        languages = sorted(texts)
        if len(languages) > 64:
            raise ValueError("a word has bits for 64 languages")
        counted = []
        for lang in languages:
            grams, _ = ngrams(texts[lang]) if texts[lang] else (np.zeros(0, np.uint64), None)
            values, counts = np.unique(grams, return_counts=True)
            counted.append((values, counts / max(1, counts.sum())))
        every = np.unique(np.concatenate([v for v, _ in counted])) if counted else np.zeros(0, np.uint64)
        most = np.zeros(len(every))
        for values, share in counted:
            at = np.searchsorted(every, values)
            most[at] = np.maximum(most[at], share)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        table = np.zeros(size, kind)
        for bit, (values, share) in enumerate(counted):
            own = values[share >= MIN_RATIO * most[np.searchsorted(every, values)]]
            for at in positions(own, size):
                table[at] |= kind(1 << bit)
        filled = np.array([((table >> kind(b)) & kind(1)).mean() for b in range(len(languages))])
        return Filters(languages, table, filled**HASHES)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the n-grams that each language contains, and all n-grams."""
        return self._tally(*ngrams(texts), len(texts))

    def _tally(self, grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.languages)
        total = np.bincount(owner, minlength=n).astype(float)
        words = self.table[(at := positions(grams, len(self.table)))[0]]
        for more in at[1:]:
            words = words & self.table[more]
        if k <= 8:  # popcounts by word: one count of each pair of text and word
            pairs = np.bincount(owner * 256 + words, minlength=n * 256).reshape(n, 256)
            return pairs @ ((np.arange(256)[:, None] >> np.arange(k)) & 1), total
        return np.stack([np.bincount(owner, weights=((words >> np.uint64(b)) & np.uint64(1)).astype(float), minlength=n) for b in range(k)], axis=1), total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and a confidence: the share of its corrected hits
        among those of all languages, times the root of its own corrected hit rate."""
        n, k = len(texts), len(self.languages)
        if not n or not k:
            return [UNKNOWN] * n, [0.0] * n
        hits, total = np.zeros((n, k)), np.zeros(n)
        run: list[int] = []
        held = 0
        for i, t in enumerate([*texts, ""]):
            if run and (i == n or held + len(t) > RUN_CHARS):
                hits[run], total[run] = self.counts([texts[j] for j in run])
                run, held = [], 0
            if i < n and len(t) <= RUN_CHARS:
                run.append(i)
                held += len(t)
            elif i < n:
                for grams in long_ngrams(t):
                    some, every = self._tally(grams, np.zeros(len(grams), np.int64), 1)
                    hits[i] += some[0]
                    total[i] += every[0]
        rate = hits / np.maximum(total, 1)[:, None]
        true = np.clip((rate - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1)
        best = true.argmax(axis=1)
        top = true[np.arange(n), best]
        score = np.where(top > 0, top / np.maximum(true.sum(axis=1), 1e-12) * np.sqrt(top), 0.0)
        known = total > 0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0).tolist()


def training_rows(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """Whole texts of at most `docs` documents of each language that the fit may see (the
    crc32 of the id modulo 4 is not 2) and that have at most `chars` characters, chosen by
    a hash of id and text; repeated rows count once. The plan itself holds the bound,
    whatever ids and texts are."""
    seen = df.where(F.col(lang).isNotNull() & (F.length(text) <= chars) & (id_crc(doc_id) % 4 != 2)).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # languages are few: a table of more than the filters can hold is refused by fit
    drawn = F.xxhash64("doc_id", "text", F.lit("language"))
    counts = {r[0]: r[1] for r in seen.groupBy("lang").agg(F.approx_count_distinct(drawn)).limit(65).collect()}
    if not counts:
        return {}
    # twice as many as are wanted pass a first draw, so that few texts are compared
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * docs + 100) / n)))])
    likely = seen.withColumn("draw", drawn).where(F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(share, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    rows = likely.distinct().withColumn("nth", nth).where(F.col("nth") <= docs).select("lang", "nth", "text").collect()
    found: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found[r[0]].append(r[2])
    return found


def language_of(df: DataFrame, filters: Filters, text: str = "text") -> Column:
    """A struct of lang_pred and score as a column of df, which keeps its other columns."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("lang_pred string, score double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = shared.value.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        given_back()

    return judged(F.coalesce(F.col(text), F.lit("")))


def identify(df: DataFrame, filters: Filters, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text.

    Texts that are null or have no letter get ``und`` and 0; with no learned language
    all do; languages that tie go to the first by name; very long texts are counted in
    runs whose n-grams are those of the whole; repeated rows are judged alike; an empty
    table gives no rows; other columns are left out. A fit of more than 64 languages is
    an error. Returns doc_id, held_out, lang_pred, score."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (id_crc(doc_id) % 4 == 2).alias("held_out"))
    # of a fixed size: POSITIONS words of the filters
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def per_slice():
        own = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            langs, scores = own.predict(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": langs, "score": scores}

        return run

    return map_slices(rows, per_slice, "doc_id long, held_out boolean, lang_pred string, score double")
