"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own hashed embedding and as the sum of the embeddings of its
character n-grams over the root of their number, so that inflected forms are met by
their stems; a word of over 40 characters, or text without spaces, enters in
overlapping pieces. The network reads
overlapping windows of words in both directions; attention pools the states of a
window, and a text's score is that of its worst window. It is trained in numpy on the
driver, on a bounded sample of labelled documents. Labels are of whole texts, so each
labelled text takes part by a window: first the one whose n-grams speak most for the
label, later the one that the network itself scores highest.
"""

from __future__ import annotations

import dataclasses
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.common import given_back, id_crc, map_slices, small_batches
from streetlens.sources.session import collected

WINDOW = 32
STRIDE = 24
HIDDEN = 12
SIZE = 16
WORD_ROWS = 1 << 14
GRAM_ROWS = 1 << 16
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.7
#: Rounds over the sample, and updates that a small sample gets at least.
EPOCHS, UPDATES = 8, 240
BATCH = 192
#: Chance that an update sees a word's own embedding besides its n-grams.
MET = 0.5
#: The bound of the fit: so many labelled documents of each label are read at most, out
#: of those of at most so many characters: long texts are scored, but teach nothing.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 3000, 40_000
#: Words whose inputs a Python worker remembers; the table starts anew when full.
REMEMBERED = 200_000
#: Windows that are scored at a time.
SCORED = 1024
#: Characters of text that are scored at a time.
RUN_CHARS = 500_000

#: A longer word becomes pieces of so many characters; the overlap holds every n-gram.
PIECE, OVERLAP = 40, 8

#: What a word may have at its ends.
_EDGES = string.punctuation + "“”„«»‘’‚…–—¿¡·"
#: What str.split() splits at.
_SPACE = re.compile(r"\s")


def plain(word: str) -> str:
    return word.lower().strip(_EDGES) or word


def steps(text: str) -> list[str]:
    """The words of a whole text; a long one is taken in consecutive pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out: list[str] = []
    for w in words:
        if len(w) <= PIECE:
            out.append(w)
        else:
            w = plain(w)
            out += [w[i : i + PIECE] for i in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]
    return out


def spans(text: str) -> Iterator[str]:
    """A text in parts of about RUN_CHARS characters that no word crosses."""
    start = 0
    while len(text) - start > RUN_CHARS and (space := _SPACE.search(text, start + RUN_CHARS)):
        yield text[start : space.start()]
        start = space.end()
    yield text[start:] if start else text


def word_features(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The row of each word, and for each n-gram length the rows of all n-grams with
    the number of n-grams of each word."""
    marked = [f"^{plain(w)}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the word's end
    grams = []
    rolling = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            mixed = rolling * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            rows = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
            grams.append(((rows[left[: len(rows)] >= n] % np.uint64(GRAM_ROWS)).astype(np.int32), np.maximum(lengths - n + 1, 0).astype(np.int32)))
    weights = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(lengths, default=1), np.uint64(0x9E3779B97F4A7C15)))])[: max(lengths, default=1)]
    place = lengths.repeat(lengths) - left
    sums = np.add.reduceat(codes * weights[place], np.cumsum(lengths) - lengths) if len(words) else np.zeros(0, np.uint64)
    rows = ((sums ^ (sums >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)
    return rows.astype(np.int64) % WORD_ROWS, grams


def _features(words: list[str], at_once: int = 4000) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """word_features of many words, in parts, since its intermediate arrays are large."""
    kind = np.uint16 if GRAM_ROWS <= 1 << 16 else np.int32
    parts = []
    for i in range(0, len(words), at_once):
        rows, grams = word_features(words[i : i + at_once])
        parts.append((rows, [(at.astype(kind), each) for at, each in grams]))
    return np.concatenate([p[0] for p in parts]), [tuple(np.concatenate([p[1][g][side] for p in parts]) for side in (0, 1)) for g in range(len(GRAMS))]


def _sum_grams(table: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    total, count = np.zeros((n, table.shape[1]), np.float32), np.zeros(n, np.int64)
    for rows, each in grams:
        has = each > 0
        if has.any():
            starts = np.cumsum(each[has]) - each[has]
            total[has] += np.add.reduceat(table[rows], starts, axis=0)
        count += each
    return total, np.maximum(count, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclasses.dataclass
class Network:
    words: np.ndarray  # WORD_ROWS x SIZE
    grams: np.ndarray  # GRAM_ROWS x SIZE
    w: np.ndarray  # 2 x 2 SIZE x 3 HIDDEN: update, reset and candidate, for each direction
    b: np.ndarray  # 2 x 3 HIDDEN
    u: np.ndarray  # 2 x HIDDEN x 3 HIDDEN
    attend: np.ndarray  # 2 x HIDDEN
    out: np.ndarray  # 2 x HIDDEN
    bias: np.ndarray  # 1

    DENSE = ("w", "b", "u", "attend", "out", "bias")

    @staticmethod
    def start(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        b = np.zeros((2, 3 * HIDDEN), np.float32)
        b[:, :HIDDEN] = -0.5
        return Network(draw(WORD_ROWS, SIZE, s=0.02), draw(GRAM_ROWS, SIZE, s=0.05), draw(2, 2 * SIZE, 3 * HIDDEN, s=0.2), b, draw(2, HIDDEN, 3 * HIDDEN, s=0.2), draw(2, HIDDEN, s=0.3), draw(2, HIDDEN, s=0.3), np.full(1, -1.0, np.float32))

    def embedded(self, words: list[str]) -> np.ndarray:
        """What each word enters as."""
        rows, grams = word_features(words)
        total, count = _sum_grams(self.grams, grams, len(words))
        return np.concatenate([self.words[rows] * MET, total / np.sqrt(count)[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What embedded words add to both directions' gates."""
        return np.concatenate([x @ self.w[0] + self.b[0], x @ self.w[1] + self.b[1]], axis=1).astype(np.float32)

    def inputs(self, words: list[str]) -> np.ndarray:
        return self.gates(self.embedded(words))

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: T x 2 x B x 3 HIDDEN, the second direction reversed in
        time; mask: T x 2 x B x 1."""
        t, _, n, _ = gates.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, 2, n, HIDDEN), np.float32)
        kept = []
        for i in range(t):
            hu = h @ self.u
            zr = _sigmoid(gates[i, :, :, : 2 * HIDDEN] + hu[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            c = np.tanh(gates[i, :, :, 2 * HIDDEN :] + r * hu[:, :, 2 * HIDDEN :])
            new = (c + z * (h - c)) * mask[i]
            if keep:
                kept.append((h, z, r, c, hu[:, :, 2 * HIDDEN :]))
            states[i] = h = new
        both = np.stack([states[:, 0], states[::-1, 1]], axis=1)
        e = np.einsum("tdnh,dh->tn", both, self.attend) + np.where(mask[:, 0, :, 0] > 0, 0, -1e9).astype(np.float32)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tdnh->dnh", a, both)
        logit = np.einsum("dnh,dh->n", pooled, self.out) + self.bias[0]
        return (logit, (both, a, pooled, kept)) if keep else logit

    def windows_logit(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows of rows of a table of inputs; -1 is no word."""
        out = []
        for start in range(0, len(ids), SCORED):
            part = ids[start : start + SCORED]
            gates, mask = _gather(table, part)
            out.append(self.forward(gates, mask))
        return np.concatenate(out) if out else np.zeros(0, np.float32)


def _gather(table: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = ids.T
    mask = np.stack([at >= 0, at[::-1] >= 0], axis=1).astype(np.float32)[:, :, :, None]
    gates = np.empty((len(at), 2, len(ids), 3 * HIDDEN), np.float32)
    gates[:, 0] = table[at, : 3 * HIDDEN]
    gates[:, 1] = table[at[::-1], 3 * HIDDEN :]
    return gates, mask


def windows(ids: np.ndarray) -> np.ndarray:
    """All windows of a text's word rows; the last one is filled up with -1."""
    n = max(1, -(-max(0, len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class _Numbers(dict):
    """Word to its row of the table; a word that is new is noted and gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


class Scorer:
    """Scores of texts, with a bounded table of the embedded words met. When it is full,
    the later half goes: the words that are frequent came first. Their inputs, more than
    twice as wide, are taken for the words of some windows at a time."""

    def __init__(self, network: Network):
        self.network = network
        self.known = _Numbers()
        self.table = np.empty((REMEMBERED, 2 * SIZE), np.float32)

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text as rows of the table; a long text is split some of it at a time."""
        row_of = self.known.__getitem__
        found = [np.fromiter(map(row_of, words), np.int32, len(words)) for words in map(steps, spans(text))]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED // 2 + REMEMBERED // 4:
            for word in list(self.known)[REMEMBERED // 2 :]:
                del self.known[word]
            if len(self.table) > REMEMBERED:
                self.table = self.table[:REMEMBERED].copy()  # a view would hold all of it
        first = len(self.known)
        found = [self.numbers(t) for t in texts]
        new, self.known.new = self.known.new, []
        if len(self.table) < len(self.known):  # one run of texts that has very many new words
            self.table = np.concatenate([self.table[:first], np.empty((len(new), 2 * SIZE), np.float32)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.table[first + i : first + i + len(part)] = self.network.embedded(part)
        return found

    def windows_logit(self, ids: np.ndarray) -> np.ndarray:
        """Logits of windows of rows of the table; -1 is no word."""
        out = []
        for start in range(0, len(ids), SCORED):
            own, at = np.unique(ids[start : start + SCORED], return_inverse=True)
            none = int(own[0] < 0)
            out.append(self.network.windows_logit(self.network.gates(self.table[own[none:]]), at.reshape(-1, WINDOW) - none))
        return np.concatenate(out)

    def score(self, texts: list[str]) -> list[float]:
        """The largest probability of a window of each text; 0 without words."""
        rows = self.rows(texts)
        cut = [windows(r) for r in rows if len(r)]
        if not cut:
            return [0.0] * len(texts)
        logits = self.windows_logit(np.concatenate(cut))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        best = iter(_sigmoid(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(float)).tolist())
        return [next(best) if len(r) else 0.0 for r in rows]


def train(texts: list[str], toxic: list[int], *, seed: int = 5) -> Network:
    """The network, from whole texts and their labels. Without both labels it keeps its
    start, with a bias by which nothing is toxic. What the driver took for it is given back."""
    net = _trained(texts, toxic, seed)
    given_back()
    return net


def _trained(texts: list[str], toxic: list[int], seed: int) -> Network:
    net = Network.start(seed)
    y_all = np.array(toxic, np.float32)
    if not len(y_all) or y_all.min() == y_all.max():
        net.out[:] = 0
        net.bias[:] = -5.0
        return net
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in steps(t)), np.int32) for t in texts]
    vocabulary = list(number)
    del number
    use = [i for i, x in enumerate(ids) if len(x)]
    ids, y_all = [ids[i] for i in use], y_all[use]
    rows, grams = _features(vocabulary)
    ends = [np.concatenate([[0], np.cumsum(each, dtype=np.int64)]) for _, each in grams]
    evidence = _evidence(ids, y_all, grams, ends)
    cut = [windows(x) for x in ids]
    counts = np.array([len(c) for c in cut])
    firsts = np.cumsum(counts) - counts
    flat = np.concatenate(cut)
    speaks = np.concatenate([np.where(part >= 0, evidence[part], -1e9).max(axis=1) for part in np.array_split(flat, -(-len(flat) // SCORED))])
    del ids, cut, evidence
    given_back()

    dense = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in Network.DENSE}
    seen_words, seen_grams = np.full(WORD_ROWS, 1e-4, np.float32), np.full(GRAM_ROWS, 1e-4, np.float32)
    step = 0
    epochs = max(EPOCHS, -(-UPDATES * BATCH // int(len(y_all) + (y_all == 0).sum())))
    choosing = {epochs * 3 // 8, epochs * 5 // 8, epochs * 7 // 8}
    for epoch in range(epochs):
        if epoch in choosing:  # from here on the network chooses
            table = np.empty((len(vocabulary), 6 * HIDDEN), np.float16)
            for i in range(0, len(vocabulary), 4000):
                table[i : i + 4000] = net.inputs(vocabulary[i : i + 4000])
            speaks = net.windows_logit(table, flat)
            del table
            given_back()
        hard = np.array([f + np.argmax(speaks[f : f + n]) for f, n in zip(firsts, counts, strict=True)])
        random = firsts + (rng.random(len(counts)) * counts).astype(np.int64)
        chosen = np.concatenate([hard, random[y_all == 0]])
        labels = np.concatenate([y_all, np.zeros(int((y_all == 0).sum()), np.float32)])
        order = rng.permutation(len(chosen))
        for start in range(0, len(order), BATCH):
            step += 1
            part = order[start : start + BATCH]
            _update(net, flat[chosen[part]], labels[part], rows, grams, ends, dense, seen_words, seen_grams, step, rng)
    return net


def _evidence(ids: list[np.ndarray], y: np.ndarray, grams, ends) -> np.ndarray:
    """For each word the largest excess of its n-grams' presence in toxic texts over
    what their presence in all texts lets expect, in standard deviations."""
    met = [np.zeros(GRAM_ROWS), np.zeros(GRAM_ROWS)]
    for x, label in zip(ids, y, strict=True):
        own = np.unique(x)
        for (rows, _), end in zip(grams, ends, strict=True):
            met[int(label)][np.unique(rows[_spans(end[own], end[own + 1])])] += 1
    expected = (met[0] + met[1]) * y.mean()
    odds = (met[1] - expected) / np.sqrt(expected + 1)
    best = np.full(len(ends[0]) - 1, -1e9)
    for rows, each in grams:
        has = each > 0
        best[has] = np.maximum(best[has], np.maximum.reduceat(odds[rows], np.cumsum(each[has]) - each[has]))
    return best


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indices of the half-open spans."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _gradients(net: Network, ids: np.ndarray, y: np.ndarray, rows, grams, ends, met_share: float, rng: np.random.Generator):
    """Of the mean log loss of windows (rows of the vocabulary): of the dense parameters,
    and for the words met their rows, n-grams and gradients by embedding."""
    own, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape) - int(own[0] < 0)
    own = own[own >= 0]
    spans = [_spans(end[own], end[own + 1]) for end in ends]
    each = [end[own + 1] - end[own] for end in ends]
    total, count = _sum_grams(net.grams, [(r[s], e) for (r, _), s, e in zip(grams, spans, each, strict=True)], len(own))
    scale = 1 / np.sqrt(count)[:, None].astype(np.float32)
    met = (rng.random((len(own), 1)) < met_share).astype(np.float32)
    x = np.concatenate([net.words[rows[own]] * met, total * scale], axis=1)
    table = np.concatenate([x @ net.w[0] + net.b[0], x @ net.w[1] + net.b[1]], axis=1)
    gates, mask = _gather(table, inverse)
    logit, (both, a, pooled, kept) = net.forward(gates, mask, keep=True)

    n = len(y)
    dl = ((_sigmoid(logit) - y) / n).astype(np.float32)
    grad = {"out": np.einsum("n,dnh->dh", dl, pooled), "bias": dl.sum(keepdims=True)}
    dpool = dl[None, :, None] * net.out[:, None, :]
    da = np.einsum("dnh,tdnh->tn", dpool, both)
    de = a * (da - (a * da).sum(axis=0))
    dboth = a[:, None, :, None] * dpool[None] + de[:, None, :, None] * net.attend[None, :, None, :]
    grad["attend"] = np.einsum("tn,tdnh->dh", de, both)
    dstates = np.stack([dboth[:, 0], dboth[::-1, 1]], axis=1)
    dgates = np.empty_like(gates)
    du = np.zeros_like(net.u)
    dh = np.zeros_like(dstates[0])
    for i in range(len(gates) - 1, -1, -1):
        h, z, r, c, hc = kept[i]
        dnew = (dstates[i] + dh) * mask[i]
        dc = dnew * (1 - z) * (1 - c * c)
        dz = dnew * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dgates[i, :, :, :HIDDEN], dgates[i, :, :, HIDDEN : 2 * HIDDEN], dgates[i, :, :, 2 * HIDDEN :] = dz, dr, dc
        dhu = np.concatenate([dz, dr, dc * r], axis=2)
        du += np.swapaxes(h, 1, 2) @ dhu
        dh = dnew * z + dhu @ np.swapaxes(net.u, 1, 2)
    grad["u"] = du
    dtable = np.zeros((len(own) + 1, 6 * HIDDEN), np.float32)
    at = np.where(inverse.T < 0, len(own), inverse.T)
    for side, index in ((0, at), (1, at[::-1])):
        g = dgates[:, side].reshape(-1, 3 * HIDDEN)
        order = np.argsort(index.reshape(-1), kind="stable")
        sorted_at = index.reshape(-1)[order]
        first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
        dtable[sorted_at[first], side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = np.add.reduceat(g[order], first, axis=0)
    dtable = dtable[:-1]
    halves = (dtable[:, : 3 * HIDDEN], dtable[:, 3 * HIDDEN :])
    grad["w"] = np.stack([x.T @ d for d in halves])
    grad["b"] = np.stack([d.sum(axis=0) for d in halves])
    dx = halves[0] @ net.w[0].T + halves[1] @ net.w[1].T

    parts = [(r[s], e) for (r, _), s, e in zip(grams, spans, each, strict=True)]
    return grad, (rows[own], dx[:, :SIZE] * met), (parts, dx[:, SIZE:] * scale)


def _update(net: Network, ids: np.ndarray, y: np.ndarray, rows, grams, ends, dense, seen_words, seen_grams, step: int, rng: np.random.Generator, rate: float = 0.01) -> None:
    grad, (word_rows, dword), (parts, dgram) = _gradients(net, ids, y, rows, grams, ends, MET, rng)
    for k in Network.DENSE:
        m, v = dense[k]
        m += 0.1 * (grad[k] - m)
        v += 0.001 * (grad[k] ** 2 - v)
        p = getattr(net, k)
        p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    _adagrad(net.words, seen_words, word_rows, dword)
    for at, each in parts:
        _adagrad(net.grams, seen_grams, at, np.repeat(dgram, each, axis=0))


def _adagrad(table: np.ndarray, seen: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float = 0.1) -> None:
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    rows = at[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    total = np.add.reduceat(grad[order], first, axis=0)
    rows = rows[first]
    seen[rows] += (total**2).mean(axis=1)
    table[rows] -= rate * total / np.sqrt(seen[rows])[:, None]


def training_rows(
    df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, chars: int = TRAIN_CHARS,
) -> tuple[list[str], list[int]]:
    """Texts and labels that the fit may see (crc32 of the id modulo 3 is not 1): at most
    `toxic` and `clean` ids of the two labels, chosen by a hash, and as many texts of at
    most `chars` characters. The plan itself holds the bounds, whatever ids and texts are."""
    seen = labels.where("toxic in (0, 1) and doc_id is not null").where(id_crc("doc_id") % 3 != 1).groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    some = lambda label, n: seen.where(F.col("toxic") == label).orderBy(F.xxhash64("of", F.lit("toxicity")), "of").limit(n)
    chosen = some(1, toxic).unionByName(some(0, clean))  # bounded by its limits, so that it may be broadcast
    rows = df.where(F.length(text) <= chars).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "text", "toxic")
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("id", "text"), "id", "text"))
    bound = F.when(F.col("toxic") == 1, F.lit(toxic)).otherwise(F.lit(clean))
    found = sorted(rows.distinct().withColumn("nth", nth).where(F.col("nth") <= bound).select("id", "text", "toxic").collect(), key=lambda r: (r[0], r[1]))
    collected(df.sparkSession)  # Spark's side of the driver is idle, and small, while the network is trained
    return [r[1] for r in found], [r[2] for r in found]


def _in_runs(own: Scorer, texts: pa.Array) -> list[float]:
    """Scores of a column, of which about RUN_CHARS characters at a time are Python's."""
    lengths = pc.utf8_length(texts).to_pylist()
    scores, start, held = [], 0, 0
    for i, n in enumerate([*lengths, 0]):
        if i == len(lengths) or (held and held + n > RUN_CHARS):
            scores += own.score(texts.slice(start, i - start).to_pylist())
            start, held = i, 0
        held += n
    return scores


def score_of(df: DataFrame, network: Network, text: str = "text") -> Column:
    """The score as a column of df, which keeps its other columns."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shared.value)
        for texts in batches:
            yield pa.array(_in_runs(own, texts), pa.float64())
        del own
        given_back()

    return scores(F.coalesce(F.col(text), F.lit("")))


def score(df: DataFrame, network: Network, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The toxicity of every whole text.

    Null, empty and white texts have no window and score 0; very long texts have all
    their windows scored, some texts at a time; repeated rows are judged alike, so that
    there are no ties to settle; an empty table gives no rows; other columns are left
    out. Returns doc_id, held_out, score, predicted."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (id_crc(doc_id) % 3 == 1).alias("held_out"))
    # of a fixed size: WORD_ROWS and GRAM_ROWS embeddings
    shared = df.sparkSession.sparkContext.broadcast(network)

    def per_slice():
        own = Scorer(shared.value)

        def run(batch: pa.RecordBatch) -> dict:
            scores = _in_runs(own, batch.column(1))
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return run

    return map_slices(rows, per_slice, "doc_id long, held_out boolean, score double, predicted int")
