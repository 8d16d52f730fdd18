from __future__ import annotations

import html
import zlib

import numpy as np
import pytest

from oracle import assert_same
from streetlens.llm import extraction, langid, licences, toxicity


def test_ngrams_by_hand():
    grams, owner = langid.ngrams(["ab", "", "a--B"])
    again, _ = langid.ngrams(["a b"])
    assert set(owner.tolist()) == {0, 2}
    assert np.array_equal(grams[owner == 2], again)
    joined, o = langid.ngrams(["x y", "zz top"])
    alone, _ = langid.ngrams(["zz top"])
    assert np.array_equal(joined[o == 1], alone)


def test_filters_have_no_false_negatives():
    texts = {"aa": ["alpha beta gamma"], "bb": ["delta epsilon zeta"]}
    f = langid.Filters.fit(texts, size=1 << 14)
    for bit, lang in enumerate(f.languages):
        grams, _ = langid.ngrams(texts[lang])
        for at in langid.positions(grams, 1 << 14):
            assert np.all((f.table[at] >> bit) & 1)
    assert f.predict(["ALPHA!! gamma", "zeta", "", "12"])[0] == ["aa", "bb", "und", "und"]
    many = langid.Filters.fit({f"l{i:02d}": [chr(0x4E00 + 10 * i) * 3 + " " + chr(0x4E01 + 10 * i) * 5] for i in range(12)})
    assert many.table.dtype == np.uint64 and many.predict([chr(0x4E00 + 30) * 3])[0] == ["l03"]


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = langid.Filters.fit(langid.training_rows(docs))
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "123 !!", None), (None, "the and of", "en")], "doc_id long, text string, lang string")
    rows = langid.identify(docs.select("doc_id", "text", "lang").unionByName(extra).withColumnRenamed("lang", "score"), filters).collect()
    assert len(rows) == docs.count() + 4
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows if r.doc_id is not None)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (-1, -2, -3)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in rows)
    none = langid.identify(docs.limit(2), langid.Filters.fit(langid.training_rows(docs.limit(0)))).collect()
    assert {r.lang_pred for r in none} == {"und"} and langid.identify(docs.limit(0), filters).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 200):
        w = toxicity.windows(np.arange(n, dtype=np.int32))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == toxicity.WINDOW
        assert all(len(set(a[a >= 0]) & set(b[b >= 0])) > 0 for a, b in zip(w, w[1:], strict=False) if (b >= 0).sum() > toxicity.STRIDE)


def test_gradients():
    """Against numeric derivatives of the loss, for some entries of each parameter."""
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(20)]
    net = toxicity.Network.start(1)
    for k in ("words", "grams", *toxicity.Network.DENSE):
        setattr(net, k, getattr(net, k).astype(np.float64) * 3)
    ids = rng.integers(0, 20, (6, toxicity.WINDOW)).astype(np.int32)
    ids[3, 10:] = -1
    y = np.array([1, 0, 1, 0, 1, 0], float)
    rows, grams = toxicity.word_features(vocabulary)
    ends = [np.concatenate([[0], np.cumsum(e)]) for _, e in grams]
    grad, (word_rows, dword), (parts, dgram) = toxicity._gradients(net, ids, y, rows, grams, ends, 2.0, rng)

    def loss():
        total, count = toxicity._sum_grams(net.grams, grams, 20)
        x = np.concatenate([net.words[rows], total / np.sqrt(count)[:, None]], axis=1)
        gates = np.concatenate([x @ net.w[0] + net.b[0], x @ net.w[1] + net.b[1]], axis=1)
        p = toxicity._sigmoid(net.forward(*toxicity._gather(gates, ids)).astype(float))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    entries = [("out", (0, 3)), ("attend", (1, 2)), ("u", (0, 2, 5)), ("u", (1, 4, 30)), ("w", (1, 3, 20)), ("w", (0, 20, 2)), ("b", (0, 30)), ("bias", (0,))]
    checks = [(getattr(net, k), at, float(grad[k][at])) for k, at in entries] + [(net.words, (int(word_rows[4]), 2), float(dword[word_rows == word_rows[4], 2].sum()))]
    at, each = parts[0]
    g = int(at[0])
    checks.append((net.grams, (g, 1), sum(float(np.repeat(dgram, e, axis=0)[a == g, 1].sum()) for a, e in parts)))
    for p, at, analytic in checks:
        keep = p[at]
        step = 3e-2
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        numeric = (up - down) / (2 * step)
        assert abs(numeric - analytic) < 2e-4 + 0.05 * abs(numeric), (at, numeric, analytic)


def test_toxicity_learns_stems_and_windows():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(400)]
    bad = ["zorkel", "quimbo"]

    def text(toxic):
        t = list(rng.choice(words, int(rng.integers(5, 120))))
        if toxic:
            t.insert(int(rng.integers(0, len(t))), str(rng.choice(bad)) + str(rng.choice(["", "s", "ish", ","])))
        return " ".join(t)

    y = [int(rng.random() < 0.3) for _ in range(500)]
    net = toxicity.train([text(t) for t in y], y)
    scorer = toxicity.Scorer(net)
    test_y = [int(i % 2) for i in range(120)]
    scores = scorer.score([text(t) for t in test_y])
    predicted = [int(s >= toxicity.THRESHOLD) for s in scores]
    assert np.mean([p == t for p, t in zip(predicted, test_y, strict=True)]) >= 0.9
    clean = " ".join(rng.choice(words, 3000))
    assert scorer.score([clean + " zorkelish " + clean])[0] >= toxicity.THRESHOLD  # far into a long text
    assert scorer.score(["", "  \n"]) == [0.0, 0.0]
    again = toxicity.train(*([text(t) for t in y[:5]], [0] * 5))
    assert max(toxicity.Scorer(again).score(["zorkel", "a b"])) < 0.1


def test_toxicity_query_shape(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumnRenamed("lang", "score")
    extra = spark.createDataFrame([(None, "x"), (-1, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    texts, labels = toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(texts) == len(labels)
    rows = toxicity.score(both, toxicity.train([], [])).collect()
    assert len(rows) == 32 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="menu"><a href=x>Home</a><a>About us</a></div>
{open}<h1>Title</h1><p>Hello <i>wor</i>ld &amp; all&nbsp;this<br>x &lt;b&gt;, a paragraph that is long enough to be where the text surges.</p><p>Short.</p>
<div class="cookie-notice">We use cookies and many other long things that nobody reads but which are long enough to be a surge.</div><ul><li>one<li>two</ul>
<p>Third one that goes on a bit longer than the second.</p>{close}
<section id="comments"><article class="comment"><p>I think this is a really great article and I want to say so at length, thanks a lot.</p></article></section>
<form>Your mail <input></form><aside>Related things of no interest whatsoever to anyone who reads this page.</aside><footer>(c) Site</footer><script>var x="</p>"</script><style>p</style>"""
TEXT = "Title Hello world & all this x <b>, a paragraph that is long enough to be where the text surges. Short. one two Third one that goes on a bit longer than the second."


@pytest.mark.parametrize("opening,closing", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")])
def test_extract(opening, closing):
    assert extraction.main_text(PAGE.format(open=opening, close=closing)) == TEXT


def test_extract_odd_pages():
    text = extraction.main_text
    assert [text(p) for p in (None, "", "<div", "<p></p>", "<!-- x", "<script>x")] == [""] * 6
    assert text("plain") == "plain" and text("<p>a &#233;&eacute;<p>b") == "a éé b" and text("<article>x <!-- y") == "x" and text("a < b") == "a < b"
    assert text("<article>" + "<p>wörd</p>" * 50_000 + "</article>") == " ".join(["wörd"] * 50_000)
    assert text("<div>" * 3000 + "deep") == "deep"


def test_extract_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import re

    def plain(p):  # these pages have one article and inline marks only inside it
        body = re.search("<article>(.*)</article>", p, re.S)[1]
        return " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]+>", " ", body))).split())

    extra = spark.createDataFrame([(-1, None, None), (None, "u", "<p>x")], pages.schema)
    rows = extraction.extract(pages.unionByName(extra).selectExpr("*", "1 as text", "2 as n_chars")).collect()
    want = {r.page_id: plain(r.html) for r in pages.collect()} | {-1: "", None: "x"}
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    assert extraction.extract(pages.limit(0)).count() == 0


def test_licences_inherit(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, "some code", "a/b/c/x.py"), (3, "x\nLicensed under the Apache License, Version 2.0.\n" + "y " * 100, "a/b/y.py"),
        (4, "This work is licensed under the GNU General Public License, version 3.", "a/b/COPYING"), (5, "t", "z/q.txt"), (6, None, "a/n"), (7, "", None), (None, "", "a/b/d"),
        (8, "I have a driving license and a copyright lawyer", "z/w.txt"), (2, "some code", "a/b/c/x.py"), (9, "w", "top"),
    ]
    got = licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, path string, licence string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.licence, r.origin, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "own", None) and by[3] == ("Apache-2.0", "own", None) and by[4] == ("GPL-3.0", "own", None)
    assert by[2] == ("GPL-3.0", "inherited", "a/b") and by[6] == ("MIT", "inherited", "a") and by[None] == ("GPL-3.0", "inherited", "a/b")
    assert by[5] == by[8] == by[9] == by[7] == (None, "none", None)
    root = licences.scan(spark.createDataFrame([(1, "Licensed under CC BY 4.0.", "LICENSE"), (2, "z", "a/b/c")], "doc_id long, text string, path string")).collect()
    assert {(r.doc_id, r.licence, r.inherited_from) for r in root} == {(1, "CC-BY-4.0", None), (2, "CC-BY-4.0", "")}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string, path string")).count() == 0


def test_altered_wording(spark):
    """Cosines under 1, wrapped files, order of ties, and own templates."""
    import textwrap

    of = {n: t for n, t in reversed(licences.TEMPLATES)}
    wrapped = {n: textwrap.fill(f"{n} notice. Copyright (c) 2020 Some Author. All rights reserved.\n" + max((t for m, t in licences.TEMPLATES if m == n), key=len), 60) for n in of}
    rows = [(10 + i, wrapped[n], f"d{i}/LICENSE") for i, n in enumerate(of) if n not in ("proprietary", "CC0-1.0")]
    rows += [(100, "Please note: this was released under a MIT style License by us.\n" + "prose and more prose here " * 50, "p/a"), (101, "He copied the license plate number of a public car.", "p/b")]
    rows += [(200, "This library is offered under the terms of the foo licence, any version.", "q/a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    names = list(of)
    for i, _, _ in rows[:-3]:
        assert got[i].licence == names[i - 10] and 0.6 <= got[i].own_score < 1 and got[i].origin == "own", names[i - 10]
    assert got[100].licence is None and got[101].licence is None and got[200].licence is None
    both = [("one", "Under the foo licence, any version."), ("two", "any version, under the FOO licence")]
    mine = {r.doc_id: r for r in licences.scan(df, templates=both).collect()}
    assert mine[200].licence is None and licences.scan(df.where("doc_id = 200"), templates=[("foo", rows[-1][1])]).first().licence == "foo"
    tied = spark.createDataFrame([(1, "under the foo licence any version", "x/LICENSE"), (2, "under the foo licence any version", "x/COPYING"), (3, "", "x/y")], "doc_id long, text string, path string")
    assert {(r.doc_id, r.licence, r.own_score) for r in licences.scan(tied, templates=both).collect()} == {(1, "one", 1.0), (2, "one", 1.0), (3, "one", 0.0)}


def test_sql_oracles(spark, sf):
    from streetlens.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        assert_same(QUERIES[name](spark, sf), sql, sf)
