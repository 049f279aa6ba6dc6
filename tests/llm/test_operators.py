"""The corpus operators on small tables, against brute force, and on awkward rows."""

import base64
import bisect
import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from kinfold.llm import bwt, licenses, membership, neardup, ngrams, packing, pieces, quality, queries, repeats, tokens, transport, warc

BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
SP = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
LONG = "a long text of many different words " + " ".join(f"word{i * 7919 % 100003}" for i in range(30_000))
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, LONG), (5, LONG), (None, "no id here at all"), (6, "ÄÖ 中文 😀 ▁ \x00"), (7, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, end long, anchor string, n int, regs string, rank int, ids string, bin int, gone_id long, spans string, span_id int, a long, key string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, very long and repeated rows, and further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), *[None] * 13) for i, t in AWKWARD], SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def random_texts(seed, n=150, vocabulary=400):
    """Documents, near copies and exact copies."""
    rng = random.Random(seed)
    words = [f"{chr(97 + i % 26)}{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))))
    return out


# 1 near-dedup


def plain_shingles(text):
    """Runs of words again, from their description: no case, no ASCII punctuation, a word may become empty."""
    words = [re.sub(r"[!-/:-@\[-`{-~]", "", w) for w in re.split(r"[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + neardup.SHINGLE]) for i in range(max(len(words) - neardup.SHINGLE + 1, 1))} if words else set()


def brute_links(texts, threshold=neardup.THRESHOLD):
    sets = [plain_shingles(t) for t in texts]
    return [(j, i) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def joined(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in range(n) if find(i) != i}


def brute_groups(texts, threshold=neardup.THRESHOLD):
    return joined(len(texts), brute_links(texts, threshold))


@pytest.mark.parametrize("few,hot", [(neardup.FEW, neardup.HOT), (0, 4)])
def test_near_duplicates_equal_brute_force(spark, few, hot):
    texts = random_texts(1)
    got = {tuple(r) for r in neardup.near_duplicates(docs(spark, texts), few=few, hot=hot).collect()}
    want = brute_groups(texts)
    assert len(got & want) >= 0.95 * len(want)
    root = dict(want)  # nothing is put together that isn't
    assert all(root.get(a, a) == root.get(b, b) for a, b in got)


def sketched(texts):
    """Rows of one bucket."""
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    rows = pa.Table.from_batches(neardup._sketch(iter(table.to_batches())))
    return rows.select(["doc_id", "n", "regs"]).append_column("refused", pa.nulls(rows.num_rows, pa.list_(pa.int64())))


def copies_in_one_bucket(seed, n, groups):
    """Near copies of a few documents; many pairs are next to the threshold."""
    rng = random.Random(seed)
    base = [[f"g{g}w{i}" for i in range(60)] for g in range(groups)]
    out = []
    for i in range(n):
        w = list(base[i % groups])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot,doubt", [(10**6, (3.0, 4.0)), (16, (3.0, 4.0)), (10**6, (3.0, -1.5)), (16, (3.0, -1.5))])
def test_no_link_of_a_bucket_is_lost(spark, tmp_path, monkeypatch, hot, doubt):
    """All documents in one bucket: whatever its size, and however many sure pairs verification refuses, the groups are those of all pairs."""
    texts = copies_in_one_bucket(3, 90, 3)
    links = brute_links(texts)
    monkeypatch.setattr(neardup, "DOUBT", doubt)
    table = sketched(texts).to_pylist()
    refused = collections.defaultdict(set)
    for turn in range(30):
        rows = [(1, r["doc_id"], r["n"], r["regs"], sorted(refused[r["doc_id"]]) or None) for r in table]
        df = spark.createDataFrame(rows, "bucket long, doc_id long, n long, regs binary, refused array<long>")
        # the functions of the group run here, so that the changed limit holds
        found = local_pairs(df, hot, f"file://{tmp_path}/{turn}")
        good = {(a, b) for a, b, _ in found} & set(links)
        bad = {(a, b) for a, b, sure in found if sure} - set(links)
        if not bad:
            break
        for a, b in bad:
            refused[a].add(b)
            refused[b].add(a)
    assert not bad and joined(len(texts), good) == joined(len(texts), links)
    if doubt[1] < 0:
        assert refused  # the case was met


def local_pairs(df, hot, folder):
    rows = df.toPandas()
    table = pa.table({"bucket": rows.bucket, "doc_id": rows.doc_id, "n": rows.n, "regs": pa.array(list(rows.regs), pa.binary()), "refused": pa.array([None if x is None else list(x) for x in rows.refused], pa.list_(pa.int64()))})
    if len(rows) <= hot:
        return [(a, b, sure) for sure, found in zip((True, False), neardup.candidate_edges(neardup.Bucket(table))) for a, b in found]
    pivots = [{**{k: table.column(k)[i].as_py() for k in ("doc_id", "n", "regs", "refused")}} for i in range(neardup.PIVOTS)]
    with_pivots = table.append_column("pivots", pa.array([pivots] * len(rows)))
    seen = pa.Table.from_batches(neardup._absorbed(neardup.THRESHOLD)(iter(with_pivots.combine_chunks().to_batches()))).to_pylist()
    left = {r["b"] for r in seen if r["a"] is None}
    out = [(r["a"], r["b"], True) for r in seen if r["a"] is not None and r["a"] != r["b"]]
    part = lambda ids, k: [i for i in ids if i % 8 == k]
    for i in range(8):
        for j in range(8):
            own, ids = set(part(left, i)), sorted({*part(left, i), *part(range(len(rows)), j)})
            if own:
                group = neardup.Bucket(table.take(ids))
                for sure, found in zip((True, False), neardup.candidate_edges(group, own=np.isin(group.ids, list(own)))):
                    out += [(a, b, sure) for a, b in found]
    return out


def test_hot_buckets_in_spark(spark):
    texts = copies_in_one_bucket(4, 120, 2) + random_texts(21, 40)
    got, split = ({tuple(r) for r in neardup.near_duplicates(docs(spark, texts), hot=h).collect()} for h in (10**6, 10))
    assert got == split


def test_shingles_are_sets_of_word_runs():
    found, at, _, _ = neardup.shingles(pa.array(["A b, c d", "a b c d", "x y", "x  Y!", "", None, "x"]))
    sets = [set(found[at == i].tolist()) for i in range(7)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] == sets[3] and len(sets[2]) == 1 and not sets[4] and not sets[5] and len(sets[6]) == 1


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**64, int(2000 * share), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**64, int(1000 * (1 - share)), dtype=np.uint64)]) for _ in range(2))
            regs = neardup.registers(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            j, _ = neardup.estimate(regs[0], 11, regs[1:], np.array([11]))
            errors.append(j[0] - len(both) / (len(a) + len(b) - len(both)))
        assert abs(np.mean(errors)) < 0.03


def test_registers_by_hand():
    least = np.array([neardup._EMPTY, np.uint64(1) << np.uint64(63), np.uint64(3) << np.uint64(61)], dtype=np.uint64)
    assert neardup.compress(least).tolist() == [0, 1 << neardup.MANTISSA, (2 << neardup.MANTISSA) | 1 << (neardup.MANTISSA - 1)]


def test_near_dedup_on_awkward_rows(spark, awkward):
    assert sorted(map(tuple, neardup.near_duplicates(awkward).collect())) == [(7, 4)]
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert neardup.near_duplicates(awkward.where("false")).count() == 0


# 2 token counts


def test_token_counts_are_the_tokenizers_own(spark, awkward):
    encode = tokens.encoding(BPE).encode_ordinary
    texts = random_texts(2, 40) + ["don't  stop\n\n1234 ...!? Überß", "<|endoftext|>", "日本語テキスト", "x" * 5000]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, texts), BPE, cache=5).collect()}
    assert got == {i: len(encode(t)) for i, t in enumerate(texts)}
    rows = sorted(((r.doc_id or 0), r.n_tokens) for r in tokens.token_counts(awkward, BPE).collect() if r.doc_id != 5)
    assert rows[:3] == [(0, len(encode("no id here at all"))), (1, None), (2, 0)] and len(rows) == 7
    assert tokens.token_counts(awkward.where("false"), BPE).count() == 0


def test_the_table_is_learned_from_the_corpus(spark):
    encode, split = tokens.encoding(BPE).encode_ordinary, tokens.regex.compile(tokens.PATTERN).findall
    rng = random.Random(24)
    texts = [" ".join(rng.choices(["zqxjkv", "the", "wyvernish", "a1b2", "über", "x" * 90], k=60)) + f" once{i}" for i in range(60)]
    words, lengths = tokens.frequent(docs(spark, texts).repartition(5), BPE, most=12)
    table = dict(zip((w.decode() for w in words.split(b"\xff")), np.frombuffer(lengths, np.uint32).tolist()))
    counts = collections.Counter(p for t in texts for p in split(t) if len(p.encode()) <= tokens.LONG)
    assert set(table) == {p for p, _ in counts.most_common(12)} and table == {w: len(encode(w)) for w in table} and max(table.values()) > 1
    assert all(split(w) == [w] for w in table)
    assert tokens.frequent(docs(spark, texts).where("false"), BPE) == (b"", b"")


# 3 quality rules


def brute_verdict(text):
    """The rules again, from their description."""
    if text is None:
        return "null"
    data = text.encode()
    if not data.strip():
        return "empty"
    pack = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False).compress
    limits = lambda n: [b for b in quality.BANDS if n < b[0]][0][1:]
    ratio, (low, high) = len(data) / len(pack(data)), limits(len(data))
    if ratio > high:
        return "repetitive"
    if ratio < max(low, quality.ascii_least(data)):
        return "incompressible"
    parts = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)] if len(data) > quality.CHUNK else []
    ratios = [(len(p), len(p) / len(pack(p)), limits(len(p)), quality.ascii_least(p)) for p in parts]
    if sum(n for n, r, (_, most), _ in ratios if r > most) > quality.MOST_BAD_CHUNKS * len(data):
        return "repetitive_chunks"
    if sum(n for n, r, (least, _), ascii_ in ratios if r < max(least, ascii_)) > quality.MOST_BAD_CHUNKS * len(data):
        return "incompressible_chunks"
    return "keep"


def test_quality_rules(spark, awkward):
    rng = random.Random(4)
    noise = "".join(chr(33 + rng.randrange(90)) for _ in range(9000))
    texts = random_texts(4, 60) + ["again and again " * 300, noise, LONG, LONG + "spam " * 40_000, "short"]
    got = {r.doc_id: r.verdict for r in quality.quality(docs(spark, texts)).collect()}
    assert got == {i: brute_verdict(t) for i, t in enumerate(texts)}
    assert got[60] == "repetitive" and got[61] == "incompressible" and got[64] == "keep"
    rows = sorted(((r.doc_id or 0), r.verdict) for r in quality.quality(awkward).collect())
    assert [v for i, v in rows if i in (1, 2, 3)] == ["null", "empty", "empty"] and len(rows) == len(AWKWARD)
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(v == "keep" for _, v in rows)
    assert quality.quality(awkward.where("false")).count() == 0


def test_the_last_chunk_counts():
    rng, pack = random.Random(18), quality.packer()
    noise = "".join(chr(33 + rng.randrange(94)) for _ in range(4000))
    prose = " ".join(f"{a} {b}" for a in ("the", "old", "green", "quiet", "broken", "near") for b in ("house", "road", "field", "river", "letter", "garden", "window") for _ in range(9))[: quality.CHUNK]
    assert [quality.judge(prose + noise[:n], pack)[2] for n in (1, 1023, 1024)] == [2, 2, 2]
    rows = [quality.judge(prose + noise[:n], pack) for n in (1000, 1300)]
    assert rows[0][4] == rows[1][4] == 1


def test_short_noise_is_rejected_and_short_prose_is_not():
    rng, pack = random.Random(17), quality.packer()
    verdict = lambda t: quality.judge(t, pack)[-1]
    for n in (128, 150, 191, 192, 230, 255, 256, 400, 511, 512, 700, 1023):
        for _ in range(40):
            assert verdict("".join(chr(33 + rng.randrange(94)) for _ in range(n))) == "incompressible"
            assert verdict(base64.b64encode(rng.randbytes(n)).decode()[:n]) == "incompressible"
    english = "It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife. However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families, that he is considered the rightful property of some one or other of their daughters."
    german = "Jemand musste Josef K. verleumdet haben, denn ohne dass er etwas Böses getan hätte, wurde er eines Morgens verhaftet. Die Köchin der Frau Grubach, seiner Zimmervermieterin, die ihm jeden Tag gegen acht Uhr früh das Frühstück brachte, kam diesmal nicht."
    chinese = "人工智能是计算机科学的一个分支，它企图了解智能的实质，并生产出一种新的能以与人类智能相似的方式做出反应的智能机器。该领域的研究包括机器人、语言识别、图像识别、自然语言处理和专家系统等。"
    for text in (english, german, chinese):
        for n in (20, 40, 60, 80, 130, 200, 240):
            assert all(verdict(text[a : a + n]) == "keep" for a in range(0, len(text) - n, 5) if len(text[a : a + n].encode()) < 256)


# 4 pieces


def test_pieces_are_those_of_the_library(spark, awkward):
    model, own = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.Encoder(SP, 50)
    rng = random.Random(5)
    alphabet = " ▁  \n\tabcdefghtheinganion.,!?áéß中文日本　\x00😀À́0123456789"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 20, 60])))
        ids = np.frombuffer(own.encode(t), np.int32).tolist()
        assert ids == model.encode(t) and own.pieces.decode(ids) == model.decode(ids)
    for n in (1, 2, 3, 7, 15, 16, 17, 63, 64, 65, 200, 1000):
        for t in (" " * n, " " * n + "a", "x" + " " * n + "the\n"):
            assert np.frombuffer(own.encode(t), np.int32).tolist() == model.encode(t)
    for _ in range(200):  # ids that no text has
        ids = [rng.randrange(model.vocab_size()) for _ in range(20)]
        assert own.pieces.decode(ids) == model.decode(ids)
    found = pieces.encode(awkward, SP)
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].ids is None and rows[2].ids == [] and rows[5].exact and not rows[6].exact and rows[5].ids == model.encode(LONG)
    assert {r.doc_id: r.text for r in pieces.decode(found, SP).collect()}[5] == LONG
    assert pieces.encode(awkward.where("false"), SP).count() == 0


def test_cover_by_backtracking_equals_merging():
    own = pieces.Pieces(SP)
    rng = random.Random(6)
    for _ in range(3000):
        w = "▁" + "".join(rng.choice("theandinoraglysmt") for _ in range(rng.randrange(1, 25)))
        assert own.cover(w) == own.merge(w)


def test_long_words_take_linear_time():
    model, own = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.Encoder(SP)
    rng = random.Random(26)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "中文日本語" * 4000, "".join(rng.choice("ACGT") for _ in range(20_000))):
        assert np.frombuffer(own.encode(text), np.int32).tolist() == model.encode(text)
    began = time.time()
    assert len(own.encode("".join(rng.choice("theandinoraglysmt") for _ in range(2 << 20)))) > 1 << 20
    assert time.time() - began < 60


def test_merges_by_heap_equal_plain_ones():
    own, rng = pieces.Pieces(SP), random.Random(27)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("theandinoraglysmtß中") for _ in range(rng.randrange(1, 48)))
        assert own._merge_long(w) == own.merge(w)


# 5 WARC


def test_warc_round_trip(spark):
    nested = warc.record("response", warc.HTTP + b"<p>", "9", "http://inner/").decode()
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, ""), (None, "http://c/\r\nX: y", nested * 3), (4, "ü", None), (5, " http://e/\t", nested[:40]), (6, "f", "WARC/1.1\r\n" * 5000), (6, "f", "WARC/1.1\r\n" * 5000)]
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, path string").repartition(2)
    want = sorted(repr(r) for r in rows if r[2] is not None)
    for split, compress in ((100, False), (1 << 20, False), (100, True), (1 << 20, True)):
        assert sorted(repr(tuple(r)) for r in warc.round_trip(pages, split, compress).collect()) == want
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_records_have_what_they_must():
    for data in (warc.record("warcinfo", b"x"), warc.record("response", b"", "7", "http://a/")):
        fields, _ = warc.header(data, 0)
        assert {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"} <= set(fields)
    # a magic without a header behind it isn't followed to the end of the file
    data, reads = b"WARC/1.1\r\nno colon here\r\n" + b"y" * (1 << 22), []
    assert list(warc.candidates(lambda a, b: reads.append((a, b)) or data[a:b], len(data), 0, 100)) == [] and len(reads) == 1


def test_warc_members_inside_payloads():
    inner = warc.member(warc.record("resource", b"inner"))
    parts = [warc.member(warc.record("warcinfo", inner * 2)), warc.member(warc.record("response", inner + random.Random(25).randbytes(200_000))), warc.member(warc.record("metadata", b""))]
    data = b"".join(parts)
    rows = list(warc.members(lambda a, b: data[a:b], len(data), 0, len(data)))
    offsets, after = (np.array(x) for x in list(zip(*rows))[:2])
    assert np.diff([*offsets[warc.reachable(offsets, after)], len(data)]).tolist() == [len(p) for p in parts]
    cut = data[: len(parts[0]) + 1000]
    assert (len(parts[0]), len(cut) + 1, -1) in list(warc.members(lambda a, b: cut[a:b], len(cut), 0, len(cut)))


def test_warc_chain():
    inner = warc.record("resource", b"inner")
    data = warc.record("warcinfo", inner * 2) + warc.record("response", b"WARC/1.1\r\nno header") + warc.record("metadata", b"")
    rows = list(warc.candidates(lambda a, b: data[a:b], len(data), 0, len(data)))
    assert len(rows) > 3
    offsets, after = (np.array(x) for x in list(zip(*rows))[:2])
    chain, at = [], 0
    while at in offsets.tolist():
        chain.append(at)
        at = int(after[offsets.tolist().index(at)])
    assert offsets[warc.reachable(offsets, after)].tolist() == chain and len(chain) == 3
    assert not warc.reachable(offsets + 1, after + 1).any()  # no record at the start


# 6 language model


def brute_model(texts, order):
    counts = {order: collections.Counter()}
    for t in texts:
        s = bytes([ngrams.START]) * (order - 1) + t.encode() + bytes([ngrams.STOP])
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut = {k: ngrams.discounts([sum(n == c for n in counts[k].values()) for c in (1, 2, 3, 4)]) for k in counts}
    total, spare = collections.Counter(), collections.Counter()
    for k in counts:
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            spare[k, g[:-1]] += cut[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, x = len(g), g[:-1]
        if (k, x) not in total:
            return p(g[1:])
        n = counts[k].get(g, 0)
        return ((n - cut[k][min(n, 3) - 1] if n else 0) + spare[k, x] * p(g[1:])) / total[k, x]

    return p


def test_language_model(spark, awkward):
    texts = ["the cat sat on the mat", "the dog sat", "", "\x02a", "\x03", "a cat and a dog, ÄÖ", "the cat sat on the mat", "zzz"]
    others = ["never seen xyz \x00", "ta"]
    model, p = ngrams.train(docs(spark, [*texts, None]), 4), brute_model(texts, 4)
    for r, t in zip(sorted(ngrams.score(docs(spark, texts + others), model, 4).collect()), texts + others):
        s = b"\xfe" * 3 + t.encode() + b"\xff"
        assert r.log_prob == pytest.approx(sum(math.log(p(s[i : i + 4])) for i in range(len(s) - 3)), abs=1e-9)
        assert r.n_symbols == len(s) - 3 and r.perplexity == pytest.approx(math.exp(-r.log_prob / r.n_symbols))
    assert sum(p(b"the" + bytes([b])) for b in range(256)) == pytest.approx(1)
    rows = {r.doc_id: r for r in ngrams.perplexities(awkward).collect()}
    assert rows[1].perplexity is None and rows[2].n_symbols == 1 and rows[5].n_symbols == len(LONG) + 1
    assert ngrams.perplexities(awkward.where("false")).count() == 0


def test_held_out_text_is_likelier_than_noise(spark):
    texts = random_texts(7, 120)
    model = ngrams.train(docs(spark, texts))
    held, noise = random_texts(8, 20), ["".join(random.Random(i).choice("qzxj#%&") for _ in range(80)) for i in range(20)]
    got = [r.perplexity for r in sorted(ngrams.score(docs(spark, held + noise), model).collect())]
    assert max(got[:20]) < min(got[20:])


def brute_word_p(texts, order):
    """The model of words again, by dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts:
        s = ["<s>"] * (order - 1) + t.split() + [""]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut = {k: ngrams.discounts([sum(n == c for n in counts[k].values()) for c in (1, 2, 3, 4)]) for k in counts}
    total, spare = collections.Counter(), collections.Counter()
    for k in counts:
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            spare[k, g[:-1]] += cut[k][min(n, 3) - 1]

    def p(g, word):
        if not g:
            return 251.0 ** -(len(word.encode()) + 1)
        k, x = len(g), g[:-1]
        if (k, x) not in total:
            return p(g[1:], word)
        n = counts[k].get(g, 0)
        return ((n - cut[k][min(n, 3) - 1] if n else 0) + spare[k, x] * p(g[1:], word)) / total[k, x]

    return p


def test_word_model(spark):
    texts = [*random_texts(12, 60, 40), "", "the cat  sat\non the mat", "ÄÖ cat"]
    others = ["the cat on", "neverseen w0 xyz", " "]
    p = brute_word_p(texts, 3)
    model = ngrams.train_words(docs(spark, [*texts, None]), 3, 100)
    assert model["shards"] > 8
    for r, t in zip(sorted(ngrams.score_words(docs(spark, texts + others), model).collect()), texts + others):
        s = ["<s>"] * 2 + t.split() + [""]
        assert r.log_prob == pytest.approx(sum(math.log(p(tuple(s[i : i + 3]), s[i + 2])) for i in range(len(s) - 2)))
        assert r.n_symbols == len(t.encode()) + 1 and r.perplexity == pytest.approx(math.exp(-r.log_prob / r.n_symbols))


def test_word_model_asks_once_for_each_word(spark, monkeypatch):
    texts = [f"the same words {i % 3} and the same words again" for i in range(300)]
    opened = ngrams.WordModel(ngrams.train_words(docs(spark, texts), 3, 100))
    columns, _ = ngrams.word_windows(pa.array(texts), 3)
    asked = collections.Counter()
    found = ngrams._found_rows
    monkeypatch.setattr(ngrams, "_found_rows", lambda raw, width, wanted: asked.update((width, int(h)) for h in wanted) or found(raw, width, wanted))
    for k in (1, 2, 3):
        asked.clear()
        part = columns[3 - k :]
        n, (total, once, twice, more) = opened.counts(k, part)
        one = [times for (width, _), times in asked.items() if width == (1 if k == 1 else 4)]
        assert one and (k == 3 or set(one) == {1})
        if k == 3:
            grams = collections.Counter(zip(*(c.tolist() for c in part)))
            contexts = collections.Counter(zip(*(c.tolist() for c in part[:-1])))
            assert n.tolist() == [grams[g] for g in zip(*(c.tolist() for c in part))]
            assert total.tolist() == [contexts[g] for g in zip(*(c.tolist() for c in part[:-1]))]
            assert (once + twice + more > 0).all()


def test_workers_of_arrow_functions_load_no_pandas():
    program = """
import pyarrow as pa
import sys
from kinfold.llm import quality
batch = pa.RecordBatch.from_pydict({"text": pa.StringArray.from_buffers(1, pa.py_buffer(b"\\0\\0\\0\\0\\1\\0\\0\\0"), pa.py_buffer(b"x"))})
assert [b.num_rows for b in quality.B.released(quality._verdicts(4096, quality.BANDS, 0.25, 3))(iter([batch]))] == [1]
assert "pandas" not in sys.modules
assert pa.StringArray.from_buffers(1, pa.py_buffer(b"\\0\\0\\0\\0\\1\\0\\0\\0"), pa.py_buffer(b"x")).to_pandas().tolist() == ["x"]
import pandas
assert pa.array(pandas.Series([1.0, None])).null_count == 1
"""
    subprocess.run([sys.executable, "-c", program], check=True, cwd=os.path.abspath(f"{quality.__file__}/../../.."))


def test_small_tables_of_packing_need_no_python_worker(spark):
    rows = packing.positional(spark.createDataFrame([("b",), ("a",)], "name string"), ["name"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    assert [(r.idx, r.name) for r in rows.orderBy("idx").collect()] == [(0, "a"), (1, "b")]


def test_word_hashes_keep_little_and_need_no_window(monkeypatch):
    words = ngrams.W
    text = "some words of any length \u4e2d\u6587 " * 12_000 + "x" * 5000 + " end"
    buf, offsets = words.text_buffers(pa.array([text]))
    starts, ends, _ = words.word_spans(buf, offsets)
    monkeypatch.setattr(words, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    whole = words.word_hashes(buf, starts, ends)
    assert len(buf) > 2 * words._WINDOW and sum(p.nbytes for p in words._POWERS) < 4 << 20
    for window in (64, 1 << 20):
        monkeypatch.setattr(words, "_WINDOW", window)
        assert (words.word_hashes(buf, starts, ends) == whole).all()


def test_discounts_by_hand():
    # Y = n1 / (n1 + 2 n2) = 10 / 20; 1 - 2 Y n2/n1, 2 - 3 Y n3/n2, 3 - 4 Y n4/n3
    assert ngrams.discounts([10, 5, 2, 1]) == pytest.approx((0.5, 1.4, 2.0))
    assert ngrams.discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)


def test_word_counts_are_packed_and_found():
    rng = np.random.default_rng(14)
    columns = [rng.integers(0, 2**64, 5, dtype=np.uint64)[rng.integers(0, 5, 3000)] for _ in range(3)]
    columns, n, grams = ngrams._summed(columns, rng.integers(1, 400, 3000))
    rows = {}
    for b in ngrams._packed(columns, n, 4):
        *words, m = ngrams._unpacked(b.column(1)[0].as_py(), 3)
        rows.update(zip(zip(*(w.tolist() for w in words)), m.tolist()))
    assert rows == dict(zip(zip(*(c.tolist() for c in columns)), n.tolist()))
    n[rng.integers(0, len(n), len(n) // 2)] = 1
    second = np.where(n == 1, 1, n % 7)
    raw = np.frombuffer(ngrams._stored_rows(grams, [n, second]), np.uint8)
    wanted = np.concatenate([grams[::-1], grams + np.uint64(1 << 30), np.array([0, 2**64 - 1], np.uint64)])
    got = ngrams._found_rows(raw, 2, wanted)
    assert n.max() > 255 and (got[0][: len(n)] == n[::-1]).all() and (got[1][: len(n)] == second[::-1]).all() and not got[:, len(n) :].any()
    many = np.unique(rng.integers(0, 2**64, 200_000, dtype=np.uint64))
    got = ngrams._found_rows(np.frombuffer(ngrams._stored_rows(many, [np.arange(len(many)) % 3 + 1]), np.uint8), 1, many[::7])
    assert (got[0] == (np.arange(len(many)) % 3 + 1)[::7]).all()
    empty = np.frombuffer(ngrams._stored_rows(many[:0], [np.zeros(0, np.int64)]), np.uint8)
    assert not ngrams._found_rows(empty, 1, many[:5]).any()


def test_small_batches_are_counted_together():
    texts = [*random_texts(15, 60, 40), "", None, "the cat", "the cat"]
    batches = [pa.record_batch({"doc_id": pa.array(range(i, i + 4), pa.int64()), "text": pa.array(texts[i : i + 4], pa.string())}) for i in range(0, 64, 4)]
    expected = collections.Counter(g for b in batches for g in zip(*(c.tolist() for c in ngrams.word_windows(b.column(1), 3)[0])))
    got, pieces = collections.Counter(), collections.Counter()
    for part in range(3):
        for b in ngrams._word_counts(3, 9, part, 3)(iter(batches)):
            pieces.update(b.column(0).to_pylist())
            *words, n = ngrams._unpacked(b.column(1)[0].as_py(), 3)
            got.update(dict(zip(zip(*(w.tolist() for w in words)), n.tolist())))
            assert b.column(0)[0].as_py() % 3 == part
    assert got == expected and max(expected.values()) > 1 and set(pieces.values()) == {1}


def test_many_different_words_are_counted_too():
    rng = np.random.default_rng(16)
    columns = [rng.integers(0, 2**64, 40, dtype=np.uint64)[rng.integers(0, 40, 500)] for _ in range(12)]  # 12 places of 9 bits: over 64
    columns = [np.append(c, c[:100]) for c in columns]
    rows = collections.Counter()
    for b in ngrams._packed_once(columns, 3):
        *words, n = ngrams._unpacked(b.column(1)[0].as_py(), 12)
        rows.update(dict(zip(zip(*(w.tolist() for w in words)), n.tolist())))
    assert rows == collections.Counter(zip(*(c.tolist() for c in columns)))
    large = np.array([1 << 40, 3])
    assert ngrams._unpacked(next(ngrams._packed([c[:2] for c in columns[:1]], large, 1)).column(1)[0].as_py(), 1)[-1].tolist() in ([1 << 40, 3], [3, 1 << 40])


def test_shards_are_read_once_for_all_that_ask(spark, tmp_path, monkeypatch):
    texts = [*random_texts(12, 60, 40), "", None, "the cat", "the cat"]
    model = ngrams.train_words(docs(spark, texts[:50]), 3, 100)
    batches = [pa.record_batch({"doc_id": pa.array(range(i, i + 4), pa.int64()), "text": pa.array(texts[i : i + 4], pa.string())}) for i in range(0, 64, 4)]
    log_p = lambda b: np.bincount((x := ngrams.word_windows(b.column(1), 3))[1], weights=np.log(ngrams.WordModel(model).p(x[0])), minlength=4)
    expected = np.concatenate([log_p(b) for b in batches])
    reads, rows = [], ngrams.WordModel.rows
    monkeypatch.setattr(ngrams.WordModel, "rows", lambda self, name, *rest: reads.append(name) or rows(self, name, *rest))
    asks = pa.Table.from_batches(ngrams._asks(model)(iter([*batches, batches[0]]))).sort_by("shard")
    found = pa.Table.from_batches(ngrams._answers(model)(iter(asks.to_batches()))).sort_by([("batch", "ascending"), ("shard", "ascending")])
    assert len(asks) > 2 * model["shards"] and len(reads) == len(set(reads)) <= 5 * model["shards"]
    uri = f"file://{tmp_path}"
    assert sum(b.num_rows for b in ngrams._kept_answers(uri)(iter(found.to_batches()))) == len(batches)
    reads.clear()
    got = pa.Table.from_batches(ngrams._words_scored(model, uri)(iter(batches)))
    assert not reads and [x or 0 for x in got.column("log_prob").to_pylist()] == expected.tolist()
    other = batches[0].slice(1, 2)  # nobody asked for it
    assert next(ngrams._words_scored(model, uri)(iter([other]))).column("log_prob").to_pylist() == expected[1:3].tolist() and reads
    asked, opened = (sorted(ngrams.score_words(docs(spark, texts), model, direct=d).collect()) for d in (0, 10**6))
    assert asked == opened and len(asked) == len(texts)


def test_perplexity_tells_shuffled_words_and_grows_with_the_text(spark):
    rng = random.Random(13)
    after = {i: [rng.randrange(300) for _ in range(4)] for i in range(300)}  # prose: each word has four that follow

    def prose(n):
        out = [rng.randrange(300)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return [f"{chr(97 + w % 26)}{w}word" for w in out]

    held = [prose(100) for _ in range(10)]
    mixed = [rng.sample(w, len(w)) for w in held]
    model = ngrams.train_words(docs(spark, [" ".join(prose(200)) for _ in range(100)]))
    got = [r.perplexity for r in sorted(ngrams.score_words(docs(spark, [" ".join(w) for w in held + mixed]), model).collect())]
    assert max(got[:10]) * 1.2 < min(got[10:])
    few, many = ([" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(n)] for n in (20, 160))
    grams = lambda texts: ngrams.train_words(docs(spark, texts))["sizes"][3]
    assert grams(many) > 6 * grams(few)


def test_words_of_scripts_without_spaces():
    columns, row = ngrams.word_windows(pa.array(["ab 中文x", None, "", "中文"]), 1)
    assert row.tolist() == [0] * 5 + [2] + [3] * 3 and (columns[0] & np.uint64(255)).tolist() == [2, 3, 3, 1, 0, 0, 3, 3, 0]
    assert columns[0][1] == columns[0][6] and columns[0][2] == columns[0][7]


# 7 suffix arrays


def test_transform_equals_sorted_suffixes(tmp_path):
    block = bwt.BLOCK
    try:
        for seed in range(25):
            rng = np.random.default_rng(seed)
            bwt.BLOCK = 64 if seed % 2 else block
            parts = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 30)).astype(np.uint32) for _ in range(rng.integers(1, 40))]
            s = bwt.build(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), f"file://{tmp_path}" if seed % 3 == 0 else None)
            rows = [r for b in s.blocks() for r in b.tolist()]
            s.delete()
            want = sorted((tuple(d[i:].tolist()), k) for k, d in enumerate(parts) for i in range(len(d)))
            assert [(r[2], r[1]) for r in rows] == [(len(a), k) for a, k in want]
            shared = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
            assert [r[3] for r in rows[1:]] == shared
    finally:
        bwt.BLOCK = block
    assert not list(tmp_path.iterdir())


def brute_spans(rows, length):
    first, covered = {}, collections.defaultdict(set)
    for i, t in sorted(set(rows)):
        w = re.split(r"[ \t\n\r\x0b\x0c]+", t.strip(" \t\n\r\x0b\x0c"))
        for p in range(len(w) - length + 1):
            if first.setdefault(tuple(w[p : p + length]), (i, p)) != (i, p):
                covered[i] |= set(range(p, p + length))
    out = set()
    for i, c in covered.items():
        for s in sorted(c):
            if s - 1 not in c:
                n = 1
                while s + n in c:
                    n += 1
                out.add((i, s, n))
    return out


@pytest.mark.parametrize("length,gram", [(50, 10), (20, 5)])
def test_repeated_spans_equal_brute_force(spark, length, gram):
    rng = np.random.default_rng(length)
    base = [[f"w{j}" for j in rng.integers(0, 30, 300)] for _ in range(5)]
    texts = []
    for i in range(120):
        w = []
        for _ in range(rng.integers(1, 5)):
            a = rng.integers(0, 250)
            w += base[rng.integers(0, 5)][a : a + rng.integers(5, 90)]
        texts.append(" \n".join(["x"] * rng.integers(40, 200) if i % 9 == 0 else w))
    texts += texts[:5]
    got = {tuple(r) for r in repeats.repeated_spans(docs(spark, texts), length, gram, collection=3000).collect()}
    assert got == brute_spans(list(enumerate(texts)), length)


def test_suffix_dedup_on_awkward_rows(spark, awkward):
    assert repeats.repeated_spans(awkward).count() == 0  # a repeated row is the same occurrence
    more = awkward.union(spark.createDataFrame([(9, "new  words\n" + LONG[:900] + " end", "en", "s", 5, *[None] * 13), (10, LONG[:900], "en", "s", 900, *[None] * 13)], SCHEMA))
    out = {r.doc_id: r for r in repeats.cut_repeats(more).collect() if r.doc_id}
    assert 10 not in out and out[5].text == LONG and out[9].n_chars == len(out[9].text)
    assert out[9].text.startswith("new  words\n") and out[9].text.endswith(" end") and len(out[9].text) < 60
    assert repeats.cut_repeats(more).columns == more.columns and repeats.cut_repeats(more).count() == more.count() - 1
    assert repeats.repeated_spans(awkward.where("false")).count() == 0


# 8 packing


def brute_pack(sizes, capacity):
    """The rounds on sorted lists; sizes by item number, largest first."""
    bins = {i: [i] for i, s in enumerate(sizes) if s > capacity // 2}
    gaps = {i: capacity - sizes[i] for i in bins}
    items = [i for i in range(len(sizes)) if i not in bins]
    while items:
        gaps = {b: g for b, g in gaps.items() if g >= max(1, min(sizes[i] for i in items))}
        free, matched, left_gap, left = [], 0, 0, {}
        for value, kind, name in sorted([(sizes[i], 0, i) for i in items] + [(g, 1, b) for b, g in gaps.items()]):
            if not kind:
                free.append(name)
            else:
                if free:
                    i = free.pop()
                    bins[name].append(i)
                    value, matched = value - sizes[i], matched + 1
                left[name] = value
                left_gap += value
        total = sum(sizes[i] for i in free)
        k = -(-(total - left_gap) // capacity) if total > left_gap else 0 if matched or not total else -(-total // capacity)
        seeds, free = free[len(free) - k :], free[: len(free) - k]
        for i in seeds:
            bins[i], left[i] = [i], capacity - sizes[i]
        items, gaps = free, left
    return bins


@pytest.mark.parametrize("one_task", [0, 30, 10**6])
def test_packing_equals_brute_force(spark, one_task):
    rng = np.random.default_rng(8)
    texts = ["y" * int(n) for n in rng.choice([0, 1, 3, 7, 10, 20, 33, 50, 51, 64, 99, 100, 101, 250], 160)]
    got = packing.pack(docs(spark, texts), 100, one_task).collect()
    pieces_ = sorted(((min(100, len(t) - a), i, a // 100) for i, t in enumerate(texts) for a in range(0, len(t), 100)), key=lambda x: (-x[0], x[1], x[2]))
    want = {frozenset(pieces_[i][1:] for i in b) for b in brute_pack([p[0] for p in pieces_], 100).values()}
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    assert {frozenset((r.doc_id, r.chunk) for r in b) for b in bins.values()} == want
    assert all(sum(r.n_bytes for r in b) <= 100 and sorted(r.position for r in b) == list(range(len(b))) for b in bins.values())
    assert sum(r.n_bytes for r in got) == sum(map(len, texts))


def first_fit(sizes, capacity):
    """Sequential best-fit decreasing: each item into the fullest sequence that has room."""
    gaps = []
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_packing_is_as_full_as_sequential_best_fit(spark):
    rng = np.random.default_rng(22)
    sizes = np.minimum(rng.lognormal(3, 1, 1500).astype(int) + 1, 1000)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, n int")
    found = packing.pack(rows, 1000, size=F.col("n")).agg(F.countDistinct("bin").alias("bins"), F.max("bin").alias("most"), F.sum("n_bytes").alias("total")).first()
    assert found.bins <= 1.02 * first_fit(sizes.tolist(), 1000) + 1 and found.most == found.bins - 1 and found.total == sizes.sum()


def test_packing_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(23)
    rows = docs(spark, ["z" * int(n) for n in rng.choice([1, 3, 7, 10, 20, 33, 50, 64, 99], 200)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n, one_task in ((3, 0), (8, 0), (8, 10**6)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, packing.pack(rows, 100, one_task).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 200


def test_sequences_have_the_bytes_of_their_pieces(spark):
    texts = ["ä" * 70, "abc", "defg" * 10, "", "x" * 100]
    packed = packing.pack(docs(spark, texts), 100)
    pieces_ = collections.defaultdict(list)
    for r in sorted(packed.collect()):
        pieces_[r.bin].append(texts[r.doc_id].encode()[r.start : r.start + r.n_bytes])
    assert {r.bin: bytes(r.data) for r in packing.sequences(packed, docs(spark, texts)).collect()} == {b: b"".join(p) for b, p in pieces_.items()}


def test_packing_of_awkward_rows(spark, awkward):
    rows = packing.pack(awkward, 1000).collect()
    assert sum(r.n_bytes for r in rows) == sum(len(t.encode()) for _, t in AWKWARD if t) and {r.doc_id for r in rows} == {3, 4, 5, 6, 7, None}
    assert packing.pack(awkward.where("false")).count() == 0


# 9 transport streams


def test_transport_round_trip_and_damage():
    rng = random.Random(9)
    for n in list(range(0, 400)) + [rng.randrange(1, 30_000) for _ in range(60)]:
        payload = rng.randbytes(n)
        data = transport.mux(payload)
        found, lost = transport.parse(data)
        assert lost == 0 and b"".join(p.payload for p in found[0].pes) == payload and found[0].continuity_errors == 0
        assert [p.pts for p in found[0].pes] == [i * transport.TICKS for i in range(len(found[0].pes))]
        assert [p.random_access for p in found[0].pes] == [i % transport.GROUP == 0 for i in range(len(found[0].pes))]
    payload = rng.randbytes(20_000)
    rows = [data[i : i + 188] for data in [transport.mux(payload)] for i in range(0, len(data), 188)]
    assert transport.parse(b"".join(rows[:9] + rows[8:]))[0][0].continuity_errors == 0  # a duplicate
    assert transport.parse(b"".join(rows[:9] + rows[10:]))[0][0].continuity_errors == 1
    assert transport.parse(b"".join(rows[2:])) == ([], 0)  # no tables
    broken = bytes([*rows[1][:10], rows[1][10] ^ 1, *rows[1][11:]])
    assert transport.parse(rows[0] + broken + b"".join(rows[2:]))[0] == []  # the map's CRC
    junk = b"G" * 5 + b"".join(rows[:3]) + b"xxGx" + b"".join(rows[3:])
    found, lost = transport.parse(junk)
    assert b"".join(p.payload for p in found[0].pes) == payload and lost == 9
    assert transport.parse(b"") == ([], 0) and transport.parse(rng.randbytes(1000))[0] == []


def packet(pid, counter, payload, start=False, field=b""):
    """188 bytes; what is left over is stuffing of the adaptation field."""
    room = 184 - len(payload)
    if room or field:
        field = bytes([room - 1]) + (field or (b"\0" if room > 1 else b"")) + b"\xff" * (room - 1 - max(len(field), 1 if room > 1 else 0))
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15]) + field + payload


def section(kind, number, body, current=1):
    data = bytes([kind, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC0 | current, 0, 0]) + body
    return b"\0" + data + transport.crc(data).to_bytes(4, "big")


def pat(*programs):
    return section(0, 1, b"".join(bytes([n >> 8, n & 255, 0xE0 | p >> 8, p & 255]) for n, p in programs))


def pmt(number, clock, *streams, current=1):
    return section(2, number, bytes([0xE0 | clock >> 8, clock & 255, 0xF0, 0]) + b"".join(bytes([k, 0xE0 | p >> 8, p & 255, 0xF0, 0]) for k, p in streams), current)


def test_transport_by_hand():
    pes = lambda i, body: b"\0\0\1" + bytes([i]) + len(body).to_bytes(2, "big") + body
    head = bytes([0x80, 0xC0, 10]) + bytes([0x31, 0x00, 0x05, 0xBF, 0x21]) + bytes([0x11, 0x00, 0x05, 0x7E, 0x41])  # by the fields of the standard: 90000 and 81696
    clock = bytes([0x10]) + bytes([0, 0, 0, 50, 0x7E, 7])  # base 100, extension 7
    tables = [packet(0, 0, pat((1, 0x1000), (2, 0x1000)), True), packet(0x1000, 0, pmt(1, 0x100, (0x1B, 0x100)), True), packet(0x1000, 1, pmt(2, 0x1FFF, (6, 0x101), (0x1B, 0x100)), True)]
    video = [packet(0x100, 0, pes(0xE0, head + b"a" * 100), True, clock), packet(0x100, 1, pes(0xE0, b"\x80\0\0" + b"b" * 20), True)]
    private = [packet(0x101, 0, pes(0xBF, b"private bytes"), True), packet(0x101, 1, pes(0xBE, b"\xff" * 30), True)]
    found, lost = transport.parse(b"".join(tables + video + private))
    assert lost == 0 and [(s.program, s.pid, s.kind) for s in found] == [(1, 0x100, 0x1B), (2, 0x100, 0x1B), (2, 0x101, 6)]
    first = found[0]
    assert [p.payload for p in first.pes] == [b"a" * 100, b"b" * 20] and first.pcr == [100 * 300 + 7] and found[1].pcr == []
    assert (first.pes[0].pts, first.pes[0].dts) == (90_000, 81_696) and first.pes[1].pts is None
    assert [p.payload for p in found[2].pes] == [b"private bytes", b"\xff" * 30] and [p.stream_id for p in found[2].pes] == [0xBF, 0xBE]
    # a map that isn't current yet counts for nothing
    assert transport.parse(packet(0, 0, pat((1, 0x1000)), True) + packet(0x1000, 0, pmt(1, 0x100, (0x1B, 0x100), current=0), True) + video[0])[0] == []


def test_lost_packets_are_no_duplicates():
    payload = random.Random(20).randbytes(10_240)
    data = transport.mux(payload, pes_bytes=1 << 14)
    rows = [data[i : i + 188] for i in range(0, len(data), 188)]
    for at in (10, 20):  # 15 and 16 packets are gone: the counter repeats, or goes on as if nothing were
        (stream,), _ = transport.parse(b"".join(rows[:at] + rows[at + 15 :]))
        assert stream.continuity_errors == 1
    twice = rows[:9] + [rows[8]] + rows[9:]
    (stream,), _ = transport.parse(b"".join(twice))
    assert stream.continuity_errors == 0 and b"".join(p.payload for p in stream.pes) == payload
    (stream,), _ = transport.parse(b"".join(rows[:9] + [rows[8]] * 2 + rows[9:]))
    assert stream.continuity_errors == 1  # no more than one


def test_transport_table(spark, awkward):
    media = transport.mux_table(awkward, "doc_id", "text")
    rows = {r.doc_id: r for r in transport.streams(media.withColumn("pts", F.lit(0)), "doc_id").collect()}
    assert 1 not in rows and rows[2].n_pes == 0 and rows[5].digest == hashlib.md5(LONG.encode()).hexdigest() and None in rows
    assert transport.streams(media.where("false"), "doc_id").count() == 0


# 10 licenses


def test_license_scan():
    scan = licenses.Scanner()
    assert len(scan.rules) > 200
    text = 'Licensed under the  Apache\nLicense, Version 2.0 (the "License"); GPLv3+, CC BY-NC 4.0 all  rights reserved https://creativecommons.org/licenses/by/4.0/ Copyright (c) 2019-2021'
    assert [f.license for f in scan.scan(text)] == ["Apache-2.0", "GPL-3.0-or-later", "CC-BY-NC-4.0", "all-rights-reserved", "CC-BY", "copyright"]
    assert [f.license for f in scan.scan("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0-only"]
    assert scan.scan("") == [] and scan.scan("İ" * 50 + " mit license")[0].start == 51


def test_prefilter_loses_nothing_and_suppression():
    scan = licenses.Scanner()
    rng = random.Random(10)
    parts = ["licensed under the apache license, version 2.0", "GNU  GPL v3", "MIT\nLicense", "cc by-sa 4.0", "released into the public domain", "BSD-3-Clause", "spdx-license-identifier: MIT OR ISC", "all rights reserved", "mozilla public license 2.0", "İß", "apache", "eclipse public license - v 1.0", "https://www.gnu.org/licenses/gpl-3.0.html"]
    for _ in range(150):
        t = rng.choice([" ", "\n", ", ", ""]).join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        every = [licenses.Found(*m.span(), r.license, r.number, r.priority) for r in scan.rules for m in r.find.finditer(t) if m.end() > m.start()]
        assert scan.scan(t) == scan.scan(t, prefilter=False)
        kept = scan.scan(t)
        inside = lambda a, b: b.start <= a.start and a.end <= b.end
        assert all(not inside(a, b) or a == b or (b.priority, b.start - b.end) > (a.priority, a.start - a.end) for a in kept for b in kept)
        assert all(f in kept or any(inside(f, k) and k.priority <= f.priority for k in kept) for f in every)


def sampled(expression, rng):
    """A string that the regular expression can match; its gaps have line ends too."""
    out = []
    for op, arg in expression:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "ANY":
            out.append(rng.choice("x \n"))
        elif op == "IN":
            kind, value = rng.choice(arg)
            out.append({"LITERAL": lambda: chr(value), "RANGE": lambda: chr(rng.randint(*value)), "CATEGORY": lambda: {"CATEGORY_SPACE": rng.choice(" \n"), "CATEGORY_DIGIT": "1"}[str(value)]}[str(kind)]())
        elif op == "BRANCH":
            out.append(sampled(rng.choice(arg[1]), rng))
        elif op == "SUBPATTERN":
            out.append(sampled(arg[3], rng))
        elif op == "MAX_REPEAT":
            out += [sampled(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 3)))]
        else:
            assert op == "AT", op
    return "".join(out)


def test_every_match_has_a_keyword_of_its_rule():
    scan, rng, plain = licenses.Scanner(), random.Random(15), licenses.rules(space=r"\s+")
    for r, p in zip(scan.rules, plain):
        texts = [sampled(re._parser.parse(p.find.pattern, re.IGNORECASE), rng) for _ in range(100)]
        texts = [t for t in texts if r.find.search(t)]
        assert texts and all(r in scan.candidates(t) for t in texts), r
    for t in ("MIT-licensed", "reprinted with the permission of", "an open source licence", "Licensed under the EUPL v. 1.2"):
        assert scan.scan(t) and scan.scan(t) == scan.scan(t, prefilter=False)
    assert scan.scan("MIT+license") == [] and scan.scan("MIT \n license")[0].license == "MIT"


def test_gaps_of_rules_cross_line_ends():
    scan, rng = licenses.Scanner(), random.Random(16)
    gaps = [(r, p) for r, p in zip(scan.rules, licenses.rules(space=r"\s+")) if re.search(r"(?<!\\)\.\{", r.find.pattern)]
    assert len(gaps) > 10
    for r, p in gaps:
        for _ in range(20):
            t = re.sub(r"\s", "\n", sampled(re._parser.parse(p.find.pattern, re.IGNORECASE), rng))
            assert r.find.search(t), r
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so."""
    assert [f.license for f in scan.scan(grant)] == [f.license for f in scan.scan(" ".join(grant.split()))] and "MIT-0" in [f.license for f in scan.scan(grant)]


@pytest.mark.parametrize("mark", [" * ", "# ", "// ", ";; ", "-- ", "dnl ", "  "])
def test_rules_read_over_comment_marks(mark):
    scan = licenses.Scanner()
    notice = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met"""
    wrapped = "\n".join(mark + line for line in notice.split("\n"))
    assert [f.license for f in scan.scan(wrapped)] == [f.license for f in scan.scan(notice)] and "BSD-2-Clause" in [f.license for f in scan.scan(wrapped)]


def test_many_detections_take_linear_time():
    rng = random.Random(19)
    found = [licenses.Found(a := rng.randrange(10**6), a + rng.randrange(1, 60), "x", 0, rng.randrange(5)) for _ in range(3000)]
    taken = []
    for f in sorted(found, key=lambda f: (f.priority, f.start - f.end, f.start, f.rule)):
        if not any(t.start <= f.start and f.end <= t.end for t in taken):
            taken.append(f)
    assert licenses.resolved(found) == sorted(taken)
    began = time.time()
    text = "Copyright (c) 2019 by someone\n" * 50_000
    assert len(licenses.Scanner().scan(text)) == 50_000 and time.time() - began < 30


def test_license_table(spark, awkward):
    assert licenses.detections(awkward).count() == 0
    rows = spark.createDataFrame([(1, "MIT License", 0), (1, "MIT License", 1), (None, "under the MIT license", 2)], "doc_id long, text string, rule int")
    assert sorted((r.doc_id or 0, r.start, r.end) for r in licenses.detections(rows).collect()) == [(0, 10, 21), (1, 0, 11), (1, 0, 11)]
    assert licenses.detections(rows.where("false")).count() == 0


def test_membership(spark):
    ids = [2**62 + 5, 2**62 + 6, -7, 0, 12]
    rows = spark.createDataFrame([(i,) for i in [*ids, None, 13, 2**62 + 4]], "doc_id long").coalesce(1)
    maybe, no = membership.split(rows, rows.where(F.col("doc_id").isin(ids)))
    assert sorted(r.doc_id for r in maybe.collect()) == sorted(ids) and {r.doc_id for r in no.collect()} == {None, 13, 2**62 + 4}
    maybe, no = membership.split(rows, rows.where("false"), bits=64)
    assert maybe.count() == 0 and no.count() == 8
