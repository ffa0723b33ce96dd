"""The corpus queries over whole sample tables: against SQL, or a plain version."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import zlib
from collections import Counter

import brute
import corpus
import numpy as np
import oracle
import pytest
from conftest import ROOT, SMALL

import corpus_pipeline
from clickloom.llm import induced, secrets, substrings
from clickloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = oracle.connect(SMALL)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SMALL).select(*names)
    assert rows(got) == sorted(cur.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_op1_held_out(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_language_mixture"](spark, SMALL).collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97


def test_op1_equals_plain_version(spark, documents):
    model = brute.language_model([(d.text, d.lang) for d in documents if zlib.crc32(str(d.doc_id).encode()) % 3 != 1])
    got = {r.doc_id: r for r in QUERIES["op1_language_mixture"](spark, SMALL).collect()}
    for d in documents[:60]:
        want = brute.languages(d.text, model)
        assert set(got[d.doc_id].shares) == set(want)
        assert all(abs(got[d.doc_id].shares[k] - v) < 1e-3 for k, v in want.items())


def test_op3_equals_plain_version(spark):
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in table]
    assert rows(QUERIES["op3_hamming_top_k"](spark, SMALL)) == brute.nearest(codes, [c for c in codes if c[0] % 100 == 0], 10)


def test_op4_equals_plain_version(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(brute.decontaminate([(d.doc_id, d.text) for d in documents], items))
    assert rows(QUERIES["op4_decontaminate"](spark, SMALL)) == want


def test_op5_equals_plain_version(spark, documents):
    assert rows(QUERIES["op5_suffix_dedup"](spark, SMALL)) == brute.repeats([(d.doc_id, d.text) for d in documents])


def test_op5_odd_texts(spark, monkeypatch):
    df, plain = corpus.documents(spark)
    assert rows(substrings.remove_repeats(df)) == brute.repeats(plain)
    # Many steps and chunks, and every shared minimiser dealt out by window.
    monkeypatch.setattr(substrings, "FREQUENT", 1)
    monkeypatch.setattr(substrings, "STEP_BYTES", 4000)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4000)
    assert rows(substrings.remove_repeats(df.repartition(3))) == brute.repeats(plain)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_op5_sends_equal_windows_of_a_text_once(spark, monkeypatch):
    """Long runs of one character and of short periods, of differing lengths: a few bytes of each are sent and sorted."""
    rng = random.Random(3)
    runs = [corpus.text(rng, 5) + rng.choice(["x", "ab", "0-="]) * rng.randint(20, 2000) + corpus.text(rng, 5) for _ in range(30)]
    line = corpus.text(rng, 30)
    runs += [line + " 1 " + line, line, line[:60] + line[40:] + line[:60], "x" * 50, "x" * 49]
    plain = list(enumerate(runs))
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(7)
    assert rows(substrings.remove_repeats(df)) == brute.repeats(plain)
    monkeypatch.setattr(substrings, "STEP_BYTES", 1)
    monkeypatch.setattr(substrings, "HEAVY", 1)
    assert rows(substrings.remove_repeats(df)) == brute.repeats(plain)

    class Shared:
        def __init__(self, value):
            self.value = value

    every = np.full(1 << (substrings.FILTER_BITS - 3), 255, np.uint8)
    known = df.selectExpr("doc_id AS id", "text", "xxhash64(text) AS code").withColumn("key", substrings._row_key())
    found = substrings._stretches(known, Shared(every), Shared(every), Shared(np.zeros(0, np.uint64)))
    longest = found.selectExpr("max(length(stretch))").first()[0]
    assert longest < 300


def test_op5_keeps_all_batches_of_a_group():
    """Offsets of 8 bytes hold a group of any size in one batch."""
    import pyarrow as pa

    def batch(i, stretch):
        arrays = [pa.array([7]), pa.array([stretch], pa.binary()), pa.array([i]), pa.array([i]), pa.array([0], pa.int32()), pa.array([len(stretch)], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in substrings.STRETCHES.split(", ")])

    whole = substrings._whole([batch(1, b"a" * 60), batch(2, b"a" * 55)])
    assert whole.num_rows == 2 and pa.types.is_large_binary(whole.schema.field("stretch").type)
    assert [r["id"] for r in substrings._classes(whole).to_pylist()] == [2]


def test_induced_sorting(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 100))) * rng.choice([1, 3])
        depth = rng.choice([3, 50])
        monkeypatch.setattr(induced, "PIECE", rng.choice([4, 1 << 19]))
        # Memory 0: every push goes to disk.
        order, common = induced.suffixes(np.frombuffer(text, np.uint8), depth, rng.choice([0, 1 << 20]))
        want = sorted(range(len(text)), key=lambda i: text[i : i + depth])
        cut = [text[i : i + depth] for i in order]
        assert cut == [text[i : i + depth] for i in want] and sorted(order) == sorted(want)
        for k in range(1, len(cut)):
            shared = next((j for j, (x, y) in enumerate(zip(cut[k - 1], cut[k])) if x != y), min(len(cut[k - 1]), len(cut[k])))
            assert common[k] == shared


def test_op7_equals_plain_version(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = secrets.fit(secrets.labelled_sample(docs))
    got = {r.doc_id: r for r in QUERIES["op7_secret_spans"](spark, SMALL).collect()}
    for d in documents:
        assert got[d.doc_id].spans == brute.listed(brute.all_spans(d.text, model))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(brute.listed(brute.base_spans(d.text)).encode()).hexdigest()


def test_op8_finds_the_article(spark):
    """The pages' articles are plain: their text is what stands between the article tags."""
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op8_main_text"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = re.sub(r"</?(?:b|a|i)\b[^>]*>", "", inside)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text)).split())
        assert got[r.page_id] == want


def test_op9_finds_the_notices_of_the_documents(spark, documents):
    """Every line that ends a document and is one of the sample's notices."""
    names = {
        "All rights reserved.": "all-rights-reserved-line",
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    want = {(d.doc_id, name) for d in documents for line, name in names.items() if line in (d.text or "")}
    assert {name for _, name in want} >= {"all-rights-reserved-line"}
    assert {(r.doc_id, r.license) for r in QUERIES["op9_license_notices"](spark, SMALL).collect()} >= want


def test_op10_equals_plain_version(spark, documents):
    assert rows(QUERIES["op10_jaccard_classes"](spark, SMALL)) == sorted(brute.jaccard_classes([(d.doc_id, d.text) for d in documents]))


def test_op11_equals_plain_version(spark):
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, SMALL).collect()
    brute.check_whitened([tuple(r) for r in got], table)
    assert {r.component for r in got} == set(range(1, 17)) and len(got) == 16 * len(table)
    assert max(r.identity_error for r in got) < 1e-9


def test_pipeline_equals_plain_version(spark, documents):
    model = brute.language_model([(d.text, d.lang) for d in documents if zlib.crc32(str(d.doc_id).encode()) % 3 != 1])
    docs = [d for d in documents if max(brute.languages(d.text, model).values(), default=-1) >= 0.0]
    classes = {i: c for i, _, c in brute.jaccard_classes([(d.doc_id, d.text) for d in docs])}
    docs = [d for d in docs if classes[d.doc_id] == d.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.decontaminate([(d.doc_id, d.text) for d in docs], items) if r[5]}
    docs = [d for d in docs if d.doc_id not in hit]
    kept = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table = secrets.fit(secrets.labelled_sample(kept))
    docs = [d for d in docs if not brute.all_spans(d.text, table)]
    want = [r for r in brute.mixed([(d.doc_id, d.text, d.source) for d in docs]) if r[5] > 0]
    assert 50 < len(want) < len(documents)
    assert rows(QUERIES["pipeline"](spark, SMALL)) == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert not Counter(r.doc_id for r in out.select("doc_id").collect()) - Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_entry_point_without_the_corpus_operators():
    code = "import sys; sys.modules['clickloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_filter_of_least_hashes_lets_few_others_pass(spark):
    """Least hashes begin with zeros alike; a filter by their first bits passes most other keys long before it is full."""
    from pyspark.sql import functions as F

    parts = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.shiftrightunsigned(F.xxhash64("id", k), 1))
    least = spark.range(40_000).select("id", F.array_min(parts).alias("h"))
    keys, others = least.where("id < 20000").select("h"), least.where("id >= 20000").select("h")
    old = substrings.FILTER_BITS
    try:
        substrings.FILTER_BITS = 18
        bits = substrings._filter(keys, "h", 20_000)
    finally:
        substrings.FILTER_BITS = old
    assert len(bits) == 1 << 15
    had, other = (np.array([r[0] for r in t.collect()], np.int64) for t in (keys, others))
    assert substrings._has(bits, had).all() and substrings._has(bits, other).mean() < 0.05
    # Many keys get more bits, up to a bound.
    assert len(substrings._filter(spark.range(10).select(F.col("id").alias("h")), "h", 1 << 40)) == 1 << (substrings.MOST_FILTER_BITS - 3)
