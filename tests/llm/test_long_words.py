from __future__ import annotations

import numpy as np

from streetlens.llm import toxicity


def test_pieces_cover_a_long_word():
    word = "".join(chr(0x4E00 + i) for i in range(1000))
    for n in (40, 41, 72, 73, 1000):
        pieces = toxicity.steps(f"a {word[:n]} b")[1:-1]
        assert all(len(p) <= toxicity.PIECE for p in pieces)
        for k in range(1, max(toxicity.GRAMS) + 1):
            assert {p[i : i + k] for p in pieces for i in range(len(p) - k + 1)} == {word[i : i + k] for i in range(n - k + 1)}


def test_all_of_a_long_word_counts():
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + i) for i in range(60)]
    run = "".join(rng.choice(letters, 200))
    scorer = toxicity.Scorer(toxicity.Network.start(1))
    start, end, changed = scorer.score([run[:60], run, run[:150] + run[:50]])
    assert len({start, end, changed}) == 3
    assert toxicity.train([run, run[::-1]] * 5, [1, 0] * 5).bias.shape == (1,)


def test_a_long_text_in_runs():
    """All n-grams of runs together are those of the whole, wherever the cuts are."""
    from streetlens.llm import langid

    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ab  .,-é日Z\n"), 700))
    for t in (text, "ab", "", "...", "a" * 50, " a", text[:40] + " " * 300 + text[40:]):
        whole, _ = langid.ngrams([t])
        for at_once in (1, 2, 3, 7, 64, 10_000):
            runs = np.concatenate([*langid.long_ngrams(t, at_once=at_once), np.zeros(0, np.uint64)])
            assert np.array_equal(runs, whole), (t[:20], at_once)
    filters = langid.Filters.fit({"aa": [text], "bb": ["x y z"]}, size=1 << 14)
    long = text * 800
    assert len(long) > langid.RUN_CHARS and filters.predict([long, "x"]) == tuple(a + b for a, b in zip(filters.predict([long]), filters.predict(["x"]), strict=True))
    hits, total = filters.counts([long])
    runs = [filters._tally(g, np.zeros(len(g), np.int64), 1) for g in langid.long_ngrams(long)]
    assert np.array_equal(hits, sum(h for h, _ in runs)) and total == sum(n for _, n in runs)


def test_toxic_only_at_the_end_of_a_text_without_spaces():
    rng = np.random.default_rng(5)
    letters = [chr(0x4E00 + i) for i in range(300)]
    bad = "毒殺死"

    def text(toxic, n=120):
        t = "".join(rng.choice(letters, n))
        return t + bad + "".join(rng.choice(letters, 5)) if toxic else t

    y = [int(rng.random() < 0.4) for _ in range(400)]
    scorer = toxicity.Scorer(toxicity.train([text(v) for v in y], y))
    long = "".join(rng.choice(letters, 1_000_000))
    clean, toxic = scorer.score([long])[0], scorer.score([long + bad])[0]
    assert toxic >= toxicity.THRESHOLD and toxic >= clean


def plain_score(net, text):
    """One word and one window at a time, by the equations of the network."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN
    x = []
    for w in toxicity.steps(text):
        rows, grams = toxicity.word_features([w])
        own = [net.grams[g].astype(float) for g, _ in grams if len(g)]
        every = np.concatenate(own) if own else np.zeros((0, toxicity.SIZE))
        x.append(np.concatenate([net.words[rows[0]].astype(float) * toxicity.MET, every.sum(axis=0) / np.sqrt(max(1, len(every)))]))
    best = 0.0 if not x else -np.inf
    start = 0
    while x:
        part = x[start : start + toxicity.WINDOW]
        states = []
        for d in (0, 1):
            at, found = np.zeros(h), []
            for v in part if d == 0 else part[::-1]:
                g, u = v @ net.w[d] + net.b[d], at @ net.u[d]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                c = np.tanh(g[2 * h :] + r * u[2 * h :])
                at = z * at + (1 - z) * c
                found.append(at)
            states.append(found if d == 0 else found[::-1])
        e = np.array([a @ net.attend[0] + b @ net.attend[1] for a, b in zip(*states, strict=True)])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logit = sum(w * (a @ net.out[0] + b @ net.out[1]) for w, a, b in zip(weight, *states, strict=True)) + net.bias[0]
        best = max(best, sig(logit))
        if start + toxicity.WINDOW >= len(x):
            break
        start += toxicity.STRIDE
    return best


def test_scores_against_a_plain_network(spark, sf):
    docs = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    net = toxicity.Network.start(9)
    net.out *= 4
    texts = [*sorted(docs, key=len)[-3:], *docs[:25], "", "one", "x" * 300]
    got = toxicity.Scorer(net).score(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-5)
    old, toxicity.REMEMBERED = toxicity.REMEMBERED, 64  # the word table is thinned over and over
    try:
        few = toxicity.Scorer(net)
        assert np.allclose([few.score([t])[0] for t in texts], got, atol=2e-5)
    finally:
        toxicity.REMEMBERED = old


def plain_languages(texts, size):
    """Sets of n-grams by language, Bloom filters as sets of positions."""
    from streetlens.llm import langid

    def grams(text):
        words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
        line = "   " + " ".join(words) + "   "
        return [line[i : i + 4] for i in range(len(line) - 3) if line[i : i + 4].strip()]

    def places(gram):
        h = 0
        for i, c in enumerate(gram):
            h = ord(c) if i == 0 else (h * 0x100000001B3 + ord(c)) % 2**64
        out = []
        for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            x = h * m % 2**64
            x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 % 2**64
            out.append(x >> 64 - (size - 1).bit_length())
        return out

    share = {}
    for lang, own in texts.items():
        found = [g for t in own for g in grams(t)]
        for g in found:
            share.setdefault(g, dict.fromkeys(texts, 0.0))[lang] += 1 / len(found)
    filters = {lang: {p for g, s in share.items() if s[lang] > 0 and s[lang] >= langid.MIN_RATIO * max(s.values()) for p in places(g)} for lang in texts}

    def judge(text):
        own = grams(text)
        if not own:
            return "und", 0.0
        rates = {}
        for lang, filled in filters.items():
            rate = sum(all(p in filled for p in places(g)) for g in own) / len(own)
            wrong = (len(filled) / size) ** 3
            rates[lang] = min(1.0, max(0.0, (rate - wrong) / max(1e-9, 1 - wrong)))
        best = max(sorted(rates), key=lambda k: rates[k])
        return best, rates[best] / max(1e-12, sum(rates.values())) * rates[best] ** 0.5

    return judge


def test_languages_against_plain_sets():
    from streetlens.llm import langid

    rng = np.random.default_rng(6)
    kinds = {"aa": "abcdeé", "bb": "defghß", "cc": "ghiabñ"}
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(1, 7))))
    text = lambda k: " ".join(word(kinds[k]) + str(rng.choice(["", ",", ". ", " 12"])) for _ in range(int(rng.integers(1, 40))))
    taught = {k: [text(k) for _ in range(8)] for k in kinds}
    size = 1 << 10  # small, so that there are false positives to correct
    filters, judge = langid.Filters.fit(taught, size=size), plain_languages(taught, size)
    asked = [text(k) for k in kinds for _ in range(15)] + ["", "12", "A", "ABC déf", "xyz"]
    got = list(zip(*filters.predict(asked), strict=True))
    for (lang, score), t in zip(got, asked, strict=True):
        want = judge(t)
        assert abs(score - want[1]) < 1e-9 and (lang == want[0] or score == 0), t


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from streetlens.llm import langid

    many = spark.range(10_000).select(F.lit(8).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    none = many.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("de"))
    same = many.withColumn("text", F.lit("the same")).withColumn("lang", F.lit("fr"))
    found = langid.training_rows(many.unionByName(none).unionByName(same), docs=50)
    assert {k: len(v) for k, v in found.items()} == {"de": 50, "en": 50, "fr": 1}
    labels = spark.createDataFrame([(8, 0, 1), (8, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.training_rows(many, labels, toxic=20, clean=20)
    assert len(texts) == 20 and set(toxic) == {1}
