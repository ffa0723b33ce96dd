"""The corpus operators against plain versions, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import corpus
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import components, decontaminate, hamming, html_main, jaccard, language, licenses, mixing, secrets, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.documents(spark)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names or df.columns) for r in df.collect())


# Language.


def spoken(n, seed):
    rng = random.Random(seed)
    return {
        "en": " ".join(rng.choice("the and of with house water bring thing under".split()) for _ in range(n)),
        "de": " ".join(rng.choice("der und nicht haus wasser bringen zwischen über".split()) for _ in range(n)),
        "fr": " ".join(rng.choice("le et avec maison eau apporter même choses où".split()) for _ in range(n)),
    }


@pytest.fixture(scope="module")
def model(spark):
    table = [(k, v) for s in range(20) for k, v in spoken(60, s).items()] + [(None, "zzz"), ("en", None)]
    return language.fit(spark.createDataFrame(table, "lang string, text string"))


def test_language_mixture(spark, model):
    one = spoken(300, 99)
    texts = [one["en"], one["de"], one["en"] + " " + one["de"], one["fr"] + " " + spoken(100, 7)["en"], None, "", "12 %", "a", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("score", F.lit("x")).withColumn("__Lettered", F.lit("no"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert model.langs == ["de", "en", "fr"]
    assert (got[0].lang_pred, got[0].shares) == ("en", {"en": 1.0})
    assert got[1].lang_pred == "de" and got[1].score == 1.0
    assert set(got[2].shares) == {"de", "en"} and abs(got[2].shares["de"] - 0.5) < 0.1
    assert got[3].lang_pred == "fr" and 0.65 < got[3].score < 0.85 and set(got[3].shares) == {"en", "fr"}
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[4].score == 0.0
    assert got[7].lang_pred in model.langs
    kept = language.keep(df, model, 0.6)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 3} and not {4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_language_without_labels(spark, model):
    none = language.fit(spark.createDataFrame([], "lang string, text string"))
    df = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(df, none).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), model).count() == 0


def test_language_odd_texts(spark, docs, model):
    df, plain = docs
    got = language.identify(df, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in plain)
    assert all(0 <= r.score <= 1 for r in got)


def test_pipeline_keeps_mixtures(spark):
    table = [(None, k, v) for s in range(20) for k, v in spoken(60, s).items()]
    a, b, c = spoken(400, 1), spoken(350, 2), spoken(250, 3)
    texts = [a["en"] + " " + b["de"] + " " + c["fr"], "a", "12 %", None, "", a["fr"]]
    schema = "doc_id long, lang string, text string"
    table += [(i, None, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(table, schema)
    got = corpus_pipeline.known_language(spark, df, "")
    assert got.columns == df.columns and rows(got.where("doc_id IS NOT NULL"), "doc_id") == [(0,), (1,), (5,)]
    found = language.identify(df, language.fit(df.where(~language.held_out()))).where("lang_pred != 'und'")
    assert got.count() == found.count()
    assert corpus_pipeline.known_language(spark, df.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_pipeline_passes_languages_on(spark):
    table = [(None, k, v) for s in range(20) for k, v in spoken(60, s).items()]
    texts = spoken(400, 1)
    table += [(i, None, texts[k]) for i, k in enumerate(sorted(texts))] + [(100, "fr", spoken(60, 30)["de"])]
    got = corpus_pipeline.known_language(spark, spark.createDataFrame(table, "doc_id long, lang string, text string"), "")
    assert rows(got.where("doc_id IS NOT NULL"), "doc_id", "lang") == [*enumerate(sorted(texts)), (100, "fr")]


# Tokens.


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df, plain = docs
    rng = random.Random(5)
    odd = ["".join(rng.choice("abC.,'’ \n\té́ÅΣς1½😀<|endoftext|> \x1c\x85-_") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    odd += ["I'm.", "it's, 'tis", "a.́ b", "end.. ,x", "<|endoftext|>. <|startoftext|>,", "<|ENDOFTEXT|>", "<|EndOfText|> a", "a <|STARTOFTEXT|>", "A.. <|endOFtext|>.", "É.", "ſ. K,", "a.,. b"]
    extra = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    plain = plain + [(10_000 + i, x) for i, x in enumerate(odd)]
    got = rows(tokens.count_tokens(df.select("doc_id", "text").unionByName(extra), path))
    n = {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in plain}
    assert got == sorted((i, len((x or "").encode()), n[i], n[i] > 2048) for i, x in plain)
    assert tokens.count_tokens(df.limit(0), path).count() == 0


# Benchmark passages.


def test_decontamination(spark, docs, monkeypatch):
    df, plain = docs
    long = [t for _, t in plain if t and len(t) > 200][:3]
    items = [(1, " ".join(long[0].split()[3:25])), (2, long[1].upper()), (10, "one, two; three-four"), (3, None), (4, ""), (5, "!"), (6, "é"), (7, "the ing"), (1, "a"), (None, " ".join(long[2].split()[5:40])), (None, "zebra unlisted")]
    plain = [*plain, (99_999, "a zebra unlisted here")]
    df = df.unionByName(spark.createDataFrame([plain[-1]], "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.decontaminate(plain, items))
    # An item without id hits its words but is not listed; here item 1 is, for its single word.
    assert [r[1:4] + r[5:] for r in want if r[0] == 99_999] == [(4, 3, 1, True)]
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert rows(decontaminate.report(decontaminate.scan(df, bench))) == want
    clean = {r[0] for r in want if not r[5]}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == clean
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # several blocks
    assert rows(decontaminate.report(decontaminate.scan(df, bench))) == want
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == clean


def test_decontamination_without_items(spark, docs):
    df, plain = docs
    got = decontaminate.report(decontaminate.scan(df, spark.createDataFrame([], "item_id long, text string")))
    assert rows(got) == sorted(brute.decontaminate(plain, []))
    assert decontaminate.scan(df.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# Nearest codes.


def test_nearest_codes(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(8)]
    codes = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) for c in base for _ in range(30)]
    codes += [base[0]] * 60 + [rng.getrandbits(64) for _ in range(40)]
    signed = [c - (1 << 64) if c >> 63 else c for c in (x & (1 << 64) - 1 for x in codes)]
    table = list(enumerate(signed))
    df = spark.createDataFrame([*table, (None, 1), (9999, None), table[3]], "id long, code long").withColumn("value", F.lit(0))
    queries = [r for r in table if r[0] % 20 == 0]
    got = rows(hamming.search(df, df.where("id % 20 = 0 AND code IS NOT NULL"), 10))
    assert got == brute.nearest(table, queries, 10)
    few = spark.createDataFrame(table[:4], "id long, code long")
    assert rows(hamming.search(few, few, 10)) == brute.nearest(table[:4], table[:4], 10)
    assert hamming.search(few.limit(0), few, 10).count() == 0


def test_nearest_codes_probe_what_the_bound_needs(spark):
    parts = hamming.segments(50_000)
    assert len(parts) == 5
    query, radius = 0, 2
    # Two bits off in a segment each, three in the others.
    far = [sum(((1 << (2 if j == i else 3)) - 1) << shift for j, (shift, _) in enumerate(parts)) for i in range(len(parts))]
    index = [(c, [i], j, (c >> shift) & ((1 << width) - 1)) for i, c in enumerate(far) for j, (shift, width) in enumerate(parts)]
    index = spark.createDataFrame(index, "code long, ids array<long>, seg int, value long")

    def found(bound):
        todo = spark.createDataFrame([(query, bound)], "query long, bound int")
        return rows(hamming._probe(todo, index, parts, radius).select("id", "distance"))

    assert found(64) == [(i, 14) for i in range(5)]
    assert found(14) == [(i, 14) for i in range(5)]
    # Within 13 there is nothing, and the last segment is not asked.
    assert found(13) == []


def test_nearest_codes_random(spark):
    rng = random.Random(11)
    table = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(3000)]
    df = spark.createDataFrame(table, "id long, code long")
    queries = table[::300]
    assert rows(hamming.search(df, df.where("id % 300 = 0"), 10)) == brute.nearest(table, queries, 10)


def test_sign_code(spark):
    vectors = [([1.0, -1.0, 0.5],), ([],), (None,), ([1.0, None],), ([float("nan")],), ([-1.0] * 63 + [2.0] + [5.0],)]
    got = [r[0] for r in spark.createDataFrame(vectors, "v array<double>").select(hamming.sign_code("v")).collect()]
    assert got == [5, None, None, None, None, -(1 << 63) + 1]


# Mixing.


def test_fill_reshares_excess():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 5}
    got = mixing.fill(sizes, {"a": 1, "b": 2, "c": 3, None: 1}, 1115)
    assert got == {"a": 30.0, "b": 300.0, None: 15.0, "c": 770.0}


def test_route_repeats_least():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b",), 5), ((), 7)]
    flows = mixing.route(patterns, {"a": 22, "b": 13})
    assert sum(f.get("a", 0) for f in flows) == 22 and sum(f.get("b", 0) for f in flows) == 13
    cost = sum(max(0, sum(f.values()) - s) + max(0, sum(f.values()) - 2 * s) for f, (_, s) in zip(flows, patterns))
    assert cost == 35 - 25  # all of the 25 words once before any a second time
    # The second source needs the shared pattern: its words are rerouted from the first.
    flows = mixing.route([(("a", "b"), 10), (("a",), 10)], {"a": 10, "b": 10})
    assert flows[0] == {"a": 0, "b": 10} and flows[1] == {"a": 10}


def test_mix(spark, docs):
    df, plain = docs
    got = mixing.mix(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in plain)
    total = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        key = tuple(r.sources)
        t = total.setdefault(key, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    for taken, size, target, source_size in total.values():
        assert size == source_size and abs(taken - target) <= 0.5
    assert rows(mixing.mix(df), "doc_id", "taken") == rows(mixing.mix(df.repartition(5)), "doc_id", "taken")
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_overlapping(spark):
    rng = random.Random(2)
    table = [(i, corpus.text(rng, rng.randint(1, 50)), rng.choice([["a"], ["b"], ["b", "a", "a"], [], None])) for i in range(300)]
    df = spark.createDataFrame(table, "doc_id long, text string, tags array<string>")
    got = mixing.mix(df, (1, 3), sources=F.col("tags")).collect()
    assert len(got) == 300 and all(r.taken == 0 for r in got if not r.sources)
    want = sum({tuple(r.sources): r.target for r in got if len(r.sources) == 1}.values())
    assert abs(sum(r.taken for r in got) - want) <= 2


# Secrets.


@pytest.fixture(scope="module")
def pairs(spark, docs):
    return secrets.fit(secrets.labelled_sample(docs[0]))


def test_secret_patterns(spark, docs, pairs):
    rng = random.Random(3)
    parts = ["password", "Token", "secret", "api_key", "APIKEY", "passwd", "AKIA", "abcdef0123456789", " : ", '="', "'=", "x9é", "😀", "=", "ABCDEFGHIJKLMNOP0123", "deadbeefdeadbeefdeadbeef", "ſecret", "toKen"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else rng.choice("ab:=\"' \n") for _ in range(rng.randint(0, 50))) for _ in range(600)]
    texts += ["token=abcdef1 " * 3000]
    df, plain = docs
    table = plain + [(10_000 + i, t) for i, t in enumerate(texts)]
    got = secrets.digest(secrets.scan(spark.createDataFrame(table, "doc_id long, text string"), pairs)).collect()
    want = {}
    for i, t in table:
        b = brute.base_spans(t)
        want[i] = (*(sum(s[1] == k for s in b) for k in range(3)), hashlib.sha256(brute.listed(b).encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want
    assert any(w[0] for w in want.values()) and any(w[1] for w in want.values())
    kept = secrets.clean(df, pairs)
    assert kept.columns == df.columns


def test_random_strings(spark, pairs):
    hidden = "q7Zr+T0xWk9LmB4vJs2Yd8Pu"
    texts = [f"see {hidden} here", "internationalisation_of_things_2020", "hash 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", None]
    got = [r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), pairs)).orderBy("doc_id").collect()]
    assert got[0] == f"random:4:{4 + len(hidden)}" and got[1] == "" and got[2] == "random:5:45" and got[4] == ""


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News, more</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, all the time, for you.</p></div>
<div id=wrapper><div class="content"><h1>A &amp; B</h1><p>First paragraph, with <b>bold</b>&nbsp;text,
   and more &eacute;<p>Second one, unclosed, is <a href=x>linked</a> once.<div class=ad>Buy, buy</div><blockquote>Quoted, long enough to count as a part.</blockquote>
<ul><li>one, item</li><li>two</li></ul></div><div class="sidebar"><p>Other, things, to, read, here, and, there.</p></div></div>
<section id="comments"><p>Nice, very nice, indeed, I must say, so nice.</p></section>
<form><p>Name, please</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    want = "A & B First paragraph, with bold text, and more é Second one, unclosed, is linked once. Quoted, long enough to count as a part. one, item two"
    assert html_main.main_text(PAGE) == want
    article = "<body><nav><a>x</a></nav><article><h1>T</h1><p>Body, text.</p><aside><p>A, side.</p></aside><div class='comments'><p>Me, too.</p></div></article><p>Foot, er.</p>"
    assert html_main.main_text(article) == "T Body, text."


def test_main_text_of_forms_math_and_sources():
    body = "<h1>T</h1><p>Body, with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> inside.</p>"
    sources = "<section><h2>Sources</h2><ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul></section>"
    page = f"<body><nav><a href=/>Home</a></nav><form><input><select><option>en</select><article>{body}{sources}</article><button>Go</button></form></body>"
    assert html_main.main_text(page) == "T Body, with x=2 inside. Sources First source Second source"
    assert html_main.main_text(f"<body><form><div>{body}</div><textarea>old</textarea></form></body>") == "T Body, with x=2 inside."


LONG = "A long paragraph, with commas, of the page, that says something about the world, and goes on for a while."


@pytest.mark.parametrize(
    "page,want",
    [
        # A form around a page without article, main or first heading; a small form is none.
        (f"<form action=x><input name=q><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><button>Go</button></form>", f"Head {LONG} {LONG}"),
        (f"<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><form><p>Your name, please</p><input></form></div>", f"Head {LONG} {LONG}"),
        (f"<article><p>{LONG}</p><form class=x><p>Subscribe, now</p></form></article>", LONG),
        # A class that only has a name among its words, and a paragraph of an article with an ambiguous name.
        (f"<div class=post><p>{LONG}</p><div class='share-of-market'><p>{LONG}</p></div></div>", f"{LONG} {LONG}"),
        (f"<article><p>Intro, here.</p><p class='notice'>{LONG}</p><div class=share><p>Share it, now</p></div></article>", f"Intro, here. {LONG}"),
        (f"<div class=post><p>{LONG}</p><p>{LONG}</p></div><div class='site-notice'><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        # Lists of links in an article: tags go, those under a heading stay.
        (f"<article><h1>T</h1><p>{LONG}</p><ul class=tags><li><a>t1</a><li><a>t2</a></ul></article>", f"T {LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><div><a>t1</a> <a>t2</a></div></article>", f"T {LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><h2>Links</h2><ul><li><a>t1</a><li><a>t2</a></ul></article>", f"T {LONG} Links t1 t2"),
        # Reader comments, and a part of a paper with the same name.
        (f"<article><h1>T</h1><p>{LONG}</p></article><section class=discussion><p>Nice, very nice.</p></section>", f"T {LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section class=discussion><p>Nice, I say.</p><form><textarea></textarea></form></section></article>", f"T {LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section class=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>", f"T {LONG} Discussion {LONG}"),
    ],
)
def test_main_text_of_ambiguous_pages(page, want):
    assert html_main.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>f</footer></body></html>") == want


@pytest.mark.parametrize("html", ["", "plain", "<", "<p", "<!--", "</p></p>", "<p><p><p>", "<div>" * 5000 + "x" + "</p>" * 5000, "<![if x]>a<![endif]>", "<script>never closed", "<p>a&#0;&#x110000;&bogus;"])
def test_broken_pages(html):
    assert isinstance(html_main.main_text(html), str)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_main.extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(html_main.main_text(PAGE)))] * 2 + [(2, 0), (3, 0)]
    assert html_main.extract(df.limit(0)).count() == 0


# Licenses.


def test_licenses(spark, docs):
    rng = random.Random(8)
    found = licenses.templates()
    table = []
    for i in range(120):
        t = rng.choice(found)
        w = list(t.words)
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = "other"
        table.append((10_000 + i, corpus.text(rng, rng.randint(0, 200)) + " " + " ".join(w).upper() + ". " + corpus.text(rng, rng.randint(0, 200))))
    table += docs[1]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("license", F.lit("x"))
    want = brute.licenses(list(dict(table).items()), found)
    got = rows(licenses.scan(df))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(want) > 60
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_windows_without_template_shingles_are_left_out(spark):
    found = [t for t in licenses.templates() if len(t.words) >= licenses.SHINGLE]
    plain = [f"w{i}" for i in range(3000)]
    notice = list(next(t for t in found if t.name == "MIT").words)
    table = [(1, plain + notice + plain), (2, plain)]
    reference, sizes = licenses._reference(spark, found), sorted({t.size for t in found})
    kept = licenses._windows(spark.createDataFrame(table, "id long, words array<string>"), reference, sizes).collect()
    # At most three windows of a size hold a place.
    assert kept and len(kept) <= 4 * len(sizes) and {r.id for r in kept} == {1}
    assert {(r["size"], r["first"]) for r in kept} >= {(licenses.SMALLEST, 3000)}


def test_short_licenses(spark):
    texts = ["some words. All rights reserved.", "ALL  RIGHTS\nreserved", "call rights reserved", "all rights are reserved", "All Rights", None, "a b all rights reserved, all rights reserved"]
    texts += ["Copyright. All rights reserved. No part may be reproduced without permission.", "x " * 5000 + "all rights_reserved"]
    df = spark.createDataFrame([*enumerate(texts), (0, "once more: all rights reserved")], "doc_id long, text string")
    got = rows(licenses.scan(df, licenses.TEMPLATES | licenses.SHORT))
    line = "all-rights-reserved-line"
    assert got == [(0, line, 1.0, 2), (1, line, 1.0, 0), (6, line, 1.0, 2), (7, "all-rights-reserved", 1.0, 0), (7, line, 1.0, 1), (8, line, 1.0, 5000)]
    assert rows(licenses.scan(df, {"one": "Reserved", "four": "all rights are reserved"}), "doc_id", "license")[-2:] == [(7, "one"), (8, "one")]


@pytest.mark.parametrize("before", [2, 20])
def test_license_bands_miss_rarely(spark, before):
    """The shortest template of one shingle, which one window holds at the head of a text and two in the middle."""
    rng = random.Random(before)
    notice = {"MIT": licenses.TEMPLATES["MIT"]}
    words = [["".join(rng.choices("abcdefghij", k=7)) for _ in range(before + 12)] for _ in range(10_000)]
    table = [(i, " ".join([*w[:before], notice["MIT"], *w[before:]])) for i, w in enumerate(words)]
    missed = len(table) - licenses.scan(spark.createDataFrame(table, "doc_id long, text string"), notice).count()
    # 0.0002 of them are two at most on average.
    assert missed <= 8


# Near-duplicates.


def test_jaccard_classes(spark, docs):
    df, plain = docs
    assert rows(jaccard.classes(df)) == sorted(brute.jaccard_classes(plain))
    assert jaccard.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_jaccard_random(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    rng = random.Random(seed)
    plain = list(enumerate(corpus.near_duplicates(rng, 30)))
    got = rows(jaccard.classes(spark.createDataFrame(plain, "doc_id long, text string")))
    want = sorted(brute.jaccard_classes(plain))
    assert got == want and len({c for *_, c in want}) < len(want)


def test_jaccard_representatives(spark, docs):
    df, plain = docs
    want = {c for _, _, c in brute.jaccard_classes(plain)}
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components(spark):
    rng = random.Random(6)
    names = [rng.getrandbits(62) for _ in range(120)]
    chain = list(zip(names[:60], names[1:60])) + [(names[70], names[71]), (names[70], names[72]), (names[80], names[80])]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len({got[x] for x in names[:60]}) == 1 and len({got[x] for x in names[70:73]}) == 1 and len(set(got.values())) == 2
    assert components.components(spark.createDataFrame([], "u long, v long")) is None


def test_many_probes_are_never_broadcast(spark):
    """A small table of queries makes millions of probes; a broadcast would bring them all to the driver."""
    from clickloom.session import materialize

    codes = spark.range(5000).select(F.xxhash64("id").alias("code"), F.array("id").alias("ids"))
    parts = hamming.segments(5000)
    index = materialize(codes.select("*", F.explode(F.array(*hamming._numbered(parts))).alias("p")).select("code", "ids", "p.seg", "p.value"), "index")
    todo = materialize(codes.select(F.col("code").alias("query"), F.lit(64).alias("bound")), "todo")
    plan = hamming._probe(todo, index, parts, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
