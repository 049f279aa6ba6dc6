"""The pipeline's stages, each against a brute-force version on its own input."""

import collections

import pytest

import corpus_pipeline
from kinfold.llm import packing, queries
from tests.llm.test_operators import AWKWARD, LONG, SCHEMA, brute_groups, brute_pack, brute_spans, brute_verdict, random_texts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_small_documents(spark):
    texts = random_texts(11, 100) + ["spam spam " * 400] + ["one " + LONG[:700], "two three " + LONG[300:1200]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    first = corpus_pipeline.quality_rules(spark, docs, "")
    good = {r.doc_id: r.text for r in first.collect()}
    assert good == {i: t for i, t in enumerate(texts) if brute_verdict(t) == "keep"} and first.columns == docs.columns
    ids = sorted(good)
    gone = {ids[i] for i, _ in brute_groups([good[i] for i in ids])}
    second = corpus_pipeline.near_dedup(spark, first, "")
    kept = {r.doc_id: r.text for r in second.collect()}
    assert kept == {i: t for i, t in good.items() if i not in gone} and second.columns == docs.columns
    third = corpus_pipeline.suffix_dedup(spark, second, "")
    spans = collections.defaultdict(set)
    for i, start, n in brute_spans(list(kept.items()), 50):
        spans[i] |= set(range(start, start + n))
    want = {i: [w for p, w in enumerate(t.split()) if p not in spans[i]] for i, t in kept.items()}
    cut = {r.doc_id: r.text for r in third.collect()}
    assert {i: t.split() for i, t in cut.items()} == {i: w for i, w in want.items() if w} and third.columns == docs.columns
    assert all(t == kept[i] for i, t in cut.items() if i not in spans)
    packed = corpus_pipeline.packed(spark, third, "").collect()
    order = sorted(((len(t.encode()), i) for i, t in cut.items()), key=lambda x: (-x[0], x[1]))
    bins = collections.defaultdict(set)
    for r in packed:
        bins[r.bin].add(r.doc_id)
    assert {frozenset(b) for b in bins.values()} == {frozenset(order[i][1] for i in b) for b in brute_pack([n for n, _ in order], 16384).values()}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, tmp_path, empty):
    rows = [(i, t, "en", None, None if t is None else len(t), *[None] * 13) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs.where("false") if empty else docs, "")
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0 if empty else docs.count() > 0


def test_run_on_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "packed"]


def test_sequences_can_be_put_together_from_what_is_kept(spark, tmp_path):
    corpus_pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path))
    texts, packed = (spark.read.parquet(str(tmp_path / n)) for n in ("2-suffix_dedup", "3-packed"))
    data = {r.bin: bytes(r.data) for r in packing.sequences(packed, texts).collect()}
    text = {r.doc_id: r.text.encode() for r in texts.collect()}
    rows = sorted(packed.collect())
    assert sorted(data) == list(range(len(data))) and all(len(d) <= packing.CAPACITY for d in data.values())
    got = collections.defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
        at = sum(x.n_bytes for x in rows if x.bin == r.bin and x.position < r.position)
        got[r.doc_id] += data[r.bin][at : at + r.n_bytes]
    assert got == {i: t for i, t in text.items() if t}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
