"""The operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import os
import re
import tempfile
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import components, decontaminate, embedding_dedup, html_text, jaccard, mixing, preference, queries, token_counts, toxicity, url_filter, warc, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


AWKWARD = [None, "", " \n\t", "one", "one", "two words", "A b c d", "é ü ñ 漢字 \U0001f600", "x " * 3000, "one two three four five six seven eight nine ten eleven"]


# words


def test_words_are_those_of_the_patterns():
    for table_, pattern in ((words.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for text in [*filter(None, AWKWARD), "a\x1cb c\x85d", "Übung-42 a_b"]:
            data = text.encode().lower()
            s = words.slices(data, table_)
            assert [data[a:b] for a, b in zip(s.starts, s.ends)] == re.findall(pattern, data)


def test_hashes_do_not_depend_on_the_place_or_the_cut(monkeypatch):
    text = " ".join(f"w{k % 50}" for k in range(5000))
    (_, _, whole, _), = words.hashed([text], words.NOT_SPACE)
    monkeypatch.setattr(words, "PIECE", 1000)
    (_, _, cut, _), = words.hashed([text], words.NOT_SPACE)
    assert (whole == cut).all() and len(set(whole.tolist())) == 50
    groups = list(words.hashed([None, "w1", "", "w2 w1"], words.NOT_SPACE))
    assert groups[0][3].tolist() == [0, 0, 1, 1, 3] and groups[0][2][0] == groups[0][2][2]


# components


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1), *((k, k + 1) for k in range(100, 160))]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 161)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 1


def brute_vectors(rows, threshold=0.98):
    ok = lambda e: e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)
    n, link = len(rows), {}
    for i, j in itertools.combinations(range(n), 2):
        (a, x, p), (b, y, q) = rows[i], rows[j]
        if a is not None and b is not None and p is not None and p == q and ok(x) and ok(y) and len(x) == len(y):
            u, v = np.array(x, float), np.array(y, float)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                link.setdefault(i, []).append(j)
                link.setdefault(j, []).append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in link.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        mine = rows[i][0]
        least = None if mine is None else min(rows[k][0] for k in seen)
        out.append((mine, len(link.get(i, [])), least, mine is not None and mine == least))
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for k in range(c):
            v = centre + rng.normal(size=16) * 0.07
            rows.append((len(rows), [float(x) for x in np.float32(v)], c % 3))
    rows += [(1000, rows[-1][1], 2), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0, None], 1), (1005, rows[0][1], None), (None, rows[0][1], 1), (1006, [1.0, 2.0], 1), (1007, [], 1), (1008, [float("inf"), 1.0], 1), (1006, [1.0, 2.0], 1), (1010, [-0.0, 2.0], 1), (1011, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component_id", F.lit("clash"))
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    rows = [(a, None if e is None else [None if x is None else float(np.float32(x)) for x in e], b) for a, e, b in rows]
    assert sorted(got, key=key) == sorted(brute_vectors(rows), key=key)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_large_groups_of_vectors_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(k, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.08)], 1) for k in range(60)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted(brute_vectors(rows))


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1)[:, None]
    turn = embedding_dedup.rotation(64, 0).T
    code = np.where(x @ turn > 0, 1, -1) / 8
    f = (code * (x @ turn)).sum(1)
    error = (code * (y @ turn)).sum(1) / f - (x * y).sum(1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= np.sqrt((1 - f**2) / f**2) * embedding_dedup.EPSILON / math.sqrt(63)).all()


# 2


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, trans, start, bounds = rng.normal(size=11), rng.normal(size=(2, 2)), rng.normal(size=2), np.array([0, 4, 4, 11])
    p, _, _ = toxicity.marginals(e, trans, start, bounds)
    for lo, hi in ((0, 4), (4, 11)):
        total, mass = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            w = math.exp(start[y[0]] + sum(e[lo + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            total += w
            mass += w * np.array(y)
        assert np.allclose(mass / total, p[lo:hi])


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(2)
    clean, bad = [f"wort{k}" for k in range(200)], ["vileish", "nastyone", "grimling"]
    texts, toxic = [], []
    for _ in range(n):
        t = list(rng.choice(clean, 30))
        y = int(rng.random() < 0.3)
        if y:
            t[5] = rng.choice(bad)
        texts.append(" ".join(t))
        toxic.append(y)
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int"), texts, toxic


def test_toxicity_held_out_and_spans(spark):
    docs, labels, texts, toxic = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    import zlib

    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [k for k in got if got[k].held_out]
    assert np.mean([got[k].predicted == toxic[k] for k in held]) > 0.97
    model = toxicity.fit(docs, labels)
    spans = {r.key: r.spans for r in toxicity.tag(docs.withColumn("text", F.concat(F.lit("Ä  "), "text")), model).collect()}
    hit = [("Ä  " + texts[k])[s.start : s.stop] for k in range(len(texts)) for s in spans[k]]
    assert hit and set(hit) <= {"vileish", "nastyone", "grimling"}
    odd = {r.key: r for r in toxicity.tag(documents(spark, AWKWARD), model).collect()}
    assert len(odd) == len(AWKWARD) and all(0 <= r.score < 0.5 for r in odd.values())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - toxic.count(0)) < 15
    assert toxicity.scores(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels, _, _ = toxic_corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_copies_of_a_text_count_once_in_any_partitions(spark):
    docs, labels, texts, toxic = toxic_corpus(spark, 300)
    only = "wort1 rareword wort2"  # a toxic document without a known toxic word, and 60 copies of it
    copied = docs.unionByName(documents(spark, [only] * 60, range(1000, 1060)))
    known = labels.unionByName(spark.createDataFrame([(k, 1, 1) for k in range(1000, 1060)], labels.schema))
    models = [toxicity.fit(copied.repartition(n), known) for n in (1, 50)]
    rare = toxicity.features(words.slices(b"rareword", words.ALNUM)).ravel()
    assert all(not np.isin(m.index, rare).any() and len(m.index) for m in models)
    assert models[0].index.tolist() == models[1].index.tolist() and np.allclose(models[0].weight, models[1].weight)
    a, b = ([r.score for r in toxicity.tag(docs, m).orderBy("key").collect()] for m in models)
    assert np.allclose(a, b)


def test_sample_is_taken_from_usable_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    docs, labels, texts, toxic = toxic_corpus(spark, 300)
    order = [r.doc_id for r in labels.where("toxic = 1").where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    first = F.col("doc_id").isin(order[:10])

    def right(docs, labels):
        got = {r.key: r.score >= 0.5 for r in toxicity.tag(table_of, toxicity.fit(docs, labels, sample=10)).collect()}
        return np.mean([got[k] == toxic[k] for k in range(len(toxic))])

    table_of = documents(spark, texts)
    # the first ones of a label are too long, have no text, or are not there
    assert right(docs.withColumn("text", F.when(first, F.repeat("text", 9)).otherwise(F.col("text"))), labels) > 0.95
    assert right(docs.withColumn("text", F.when(~first, F.col("text"))), labels) > 0.95
    assert right(docs.where(~first), labels) > 0.95
    # an id that is repeated more often than the sample is large, and is not held out
    assert right(docs.unionByName(documents(spark, ["wort1 wort2"] * 40, [-1] * 40)), labels.unionByName(spark.createDataFrame([(-1, 1, 0)], labels.schema))) > 0.95
    # all documents of a label are long
    assert right(docs.join(labels, "doc_id").withColumn("text", F.when(F.col("toxic") == 1, F.repeat(F.concat("text", F.lit(" ")), 9)).otherwise(F.col("text"))).select(docs.columns), labels) > 0.95


def test_chain_is_fitted_in_pieces_of_bounded_memory(monkeypatch):
    import tracemalloc

    assert (toxicity.SAMPLE, toxicity.SAMPLE_CHARS) >= (1000, 20_000) and toxicity.SAMPLE_CHARS >= 20_000
    rng = np.random.default_rng(8)
    n = np.append(rng.integers(0, 3000, 800), [0, 0])
    hits = np.minimum(n, rng.integers(0, 9, len(n)))
    at = np.concatenate([np.sort(rng.choice(max(k, 1), h, replace=False)) for k, h in zip(n, hits)])
    f, label = rng.integers(0, 7, len(at)), rng.integers(0, 2, len(n))
    tracemalloc.start()
    cut = toxicity._fit_chain(toxicity._pieces(n, hits, at, f, label), 7, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 < 200 * n.sum()
    monkeypatch.setattr(toxicity, "CHAIN", 1 << 40)
    pieces = toxicity._pieces(n, hits, at, f, label)
    assert len(pieces) == 1 and all(np.allclose(a, b) for a, b in zip(cut, toxicity._fit_chain(pieces, 7, 2)))


# 3


def test_very_long_texts_are_scored_in_parts(spark, monkeypatch):
    docs, labels, texts, toxic = toxic_corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    text = " ".join(t for t, y in zip(texts, toxic) if y)
    long = documents(spark, ["wort1 wort2 wort3 " * 400 + text, "wort1 wort2 wort3 " * 500, "x" * 5000])
    whole = sorted(toxicity.tag(long, model).collect())
    counts = {}
    for part in (1 << 21, 1000):
        monkeypatch.setattr(toxicity, "PART", part)
        batch = pa.RecordBatch.from_arrays([pa.array([text, "wort1 wort2 " * 900]), pa.array([1, 0])], ["text", "toxic"])
        counts[part] = [b.to_pydict() for b in toxicity._count(iter([batch]))]
    assert counts[1000] == counts[1 << 21]
    score, spans = toxicity._scored(toxicity._pad(model), model.table(), [r.text for r in long.orderBy("doc_id").collect()], 0.5)
    assert np.allclose(score, [r.score for r in whole], atol=0.05)
    assert [(x["start"], x["stop"]) for x in spans[0]] == [(x.start, x.stop) for x in whole[0].spans] and whole[0].spans


@pytest.mark.parametrize("rule", ["most", "first", "share"])
def test_attribution(rule):
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 6, 30)
        size = int(lengths.sum())
        starts = np.unique(np.concatenate([[0], rng.integers(1, size, 12)]))
        got, crossing = token_counts.attribute(lengths, starts, size, rule)
        want, shared = np.zeros(len(starts)), np.zeros(len(starts), int)
        at = 0
        for n in lengths:
            held = [sum(1 for b in range(at, at + n) if np.searchsorted(starts, b, side="right") - 1 == s) for s in range(len(starts))]
            inside = [s for s, h in enumerate(held) if h]
            if len(inside) > 1:
                shared[inside] += 1
            if rule == "share":
                want += np.array(held) / n
            else:
                want[inside[0] if rule == "first" else max(inside, key=lambda s: (held[s], -s))] += 1
            at += n
        assert np.allclose(got, want) and (crossing == shared).all() and abs(got.sum() - len(lengths)) < 1e-9


def test_token_counts_add_up(spark):
    docs = documents(spark, [*AWKWARD, "First. Second one! Third\nfourth? 漢字. End"])
    encoding, _ = token_counts.encoder()
    rows = token_counts.section_tokens(docs).collect()
    for k, text in enumerate(r.text for r in docs.orderBy("doc_id").collect()):
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert sum(r.n_tokens for r in mine) == len(encoding.encode_ordinary(text or ""))
        assert mine[0].start == 0 and mine[-1].stop == len(text or "") and all(a.stop == b.start for a, b in itertools.pairwise(mine))
    assert any(r.n_crossing for r in rows)


def test_section_tokens_equal_brute_force(spark):
    docs = table(spark, "documents").limit(60).unionByName(documents(spark, [*AWKWARD, "a b. c! d? e\nf\n\n. ", "漢字。 x. y 😀! z" * 30], [1000 + k for k in range(len(AWKWARD) + 2)]).select(*table(spark, "documents").columns))
    encoding, _ = token_counts.encoder()
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        cuts = [0] + [m.end() for m in re.finditer(rb"\n|(?<=[.!?]) ", data) if m.end() < len(data)]
        section = [sum(1 for c in cuts if c <= b) - 1 for b in range(len(data))] if len(data) < 20_000 else np.searchsorted(cuts, np.arange(len(data)), side="right") - 1
        count, cross, at = Counter(), Counter(), 0
        for t in encoding.encode_ordinary(r.text or ""):
            held = Counter(int(section[b]) for b in range(at, at + len(encoding.decode_single_token_bytes(t))))
            at += sum(held.values())
            count[max(held, key=lambda x: (held[x], -x))] += 1
            cross.update(held if len(held) > 1 else [])
            cross = Counter({k: v if k not in held or len(held) < 2 else v - held[k] + 1 for k, v in cross.items()})
        ends = [*cuts[1:], len(data)]
        want += [(r.doc_id, k, len(data[:a].decode()), len(data[:b].decode()), float(count[k]), cross[k]) for k, (a, b) in enumerate(zip(cuts, ends))]
    assert sorted(tuple(r) for r in token_counts.section_tokens(docs).collect()) == sorted(want)
    assert token_counts.section_tokens(docs.limit(0)).count() == 0


# 4


def pages(spark, htmls, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], f"http://a.example/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))


def test_warc_round_trip(spark):
    htmls = ["<p>ä</p>", None, "", "same", "same", "<p>ä</p>", "\r\n\r\nWARC/1.1\r\n", "x" * 100_000, "same"]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, htmls)).collect()}
    first = {}
    for k, h in enumerate(htmls):
        p = (h or "").encode()
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(p), warc.digest(p))
        to = first.setdefault(p, k)
        assert (r.record_type, r.refers_to) == (("response", None) if to == k else ("revisit", to))
    assert warc.round_trip(pages(spark, htmls, [None, 5, 5, 7, None, 3, 1, 2, 7])).count() == 9
    assert warc.round_trip(pages(spark, htmls).limit(0)).count() == 0


def test_archives_are_ordinary_gzip(spark):
    at = "file://" + tempfile.mkdtemp(prefix="spark-warc-") + "/out"
    warc.write(pages(spark, ["a", "b", "a"]).coalesce(1), at, least=1)
    folder = at.removeprefix("file://")
    data = b"".join(open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.startswith("part"))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    make = (lambda d: warc.member(d)) if packed else (lambda d: d)
    records = [make(warc.record(k, "u", f"payload {k}".encode() * 50, None, "2024-01-01T00:00:00Z")) for k in range(6)]
    whole = b"".join(records)
    assert [x[3][1] for x in warc.salvage(whole)] == [f"payload {k}".encode() * 50 for k in range(6)]
    broken = bytearray(whole)
    at = sum(map(len, records[:2])) + len(records[2]) // 2
    broken[at : at + 20] = b"\xff" * 20
    broken[0:0] = b"junk"
    found = list(warc.salvage(bytes(broken)))
    good = [int(x[3][1][8:9]) for x in found if x[0] == "record"]
    gaps = [x[1:3] for x in found if x[0] == "gap"]
    assert good == [0, 1, 3, 4, 5]
    assert gaps == [(0, 4), (4 + sum(map(len, records[:2])), 4 + sum(map(len, records[:3])))]
    cut = list(warc.salvage(whole[:-30]))
    assert len(cut) == 6 and cut[-1][0] == "gap" and cut[-1][2] == len(whole) - 30
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member():
    records = [warc.record(k, "u", f"payload {k}".encode() * 50, None, "2024-01-01T00:00:00Z") for k in range(6)]
    bad = bytearray(b"".join(records))
    at = sum(map(len, records[:2])) + len(records[2]) - 40
    bad[at : at + 8] = b"XXXXXXXX"
    found = list(warc.salvage(warc.member(bytes(bad)) + warc.member(records[0])))
    assert [int(x[3][1][8:9]) for x in found if x[0] == "record"] == [0, 1, 3, 4, 5, 0]
    lo, hi = sum(map(len, records[:2])), sum(map(len, records[:3]))
    assert [x[3] for x in found if x[0] == "gap"] == [f"block digest differs, bytes {lo} to {hi} of the member"]
    # one member for all, damaged near its end
    rng = np.random.default_rng(1)
    long = [warc.record(k, "u", rng.bytes(40_000), None, "2024-01-01T00:00:00Z") for k in range(6)]
    packed = bytearray(gzip.compress(b"".join(long)))
    packed[-60_000] ^= 0xFF
    packed[-59_000:-58_900] = b"\0" * 100
    found = list(warc.salvage(bytes(packed)))
    assert sum(x[0] == "record" for x in found) >= 4 and found[-1][0] == "gap" and found[-1][2] == len(packed)


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    at = "file://" + tempfile.mkdtemp(prefix="spark-warc-") + "/out"
    warc.write(pages(spark, ["x" * 500 + str(k) for k in range(30)]).coalesce(1), at)
    assert len([n for n in os.listdir(at.removeprefix("file://")) if n.startswith("part")]) > 5
    assert warc.read(spark, at).count() == 30


# 5


def test_preference_equals_its_sql(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (2, 0, "user", "q"), (4, 0, None, None), (5, 0, None, None), (5, 1, "assistant", "z"), (6, 0, "user", "d"), (6, 0, "user", "d"), (7, 0, "user", "d"), (None, 0, "user", "n"), (8, None, "user", "n"), (9, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.format_pairs(preference.neighbours(df))
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = c.sql(preference.SQL)
    at = [want.columns.index(x) for x in got.columns]
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    by = {(r.pair_id, r.part, r.turn): r.loss for r in got.collect()}
    assert by[(0, "prompt", 0)] is False and by[(0, "chosen", 1)] is True and by[(0, "rejected", 1)] is True
    assert preference.format_pairs(preference.neighbours(df.limit(0))).count() == 0


# 6


def brute_sets(texts, k, p, q):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def near_copies(seed=0, groups=6, size=9):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = list(rng.choice(vocabulary, 60))
    texts = []
    for g in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 400))))
        for _ in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 25 + 1))):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(t + (passage if g % 2 else [])))
    return texts


@pytest.mark.parametrize("k,p,block", [(3, 90, 512), (5, 80, 512), (2, 60, 4)])
def test_jaccard(spark, monkeypatch, k, p, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    texts = [*AWKWARD, *near_copies(k)]
    sets, want = brute_sets(texts, k, p, 100)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(documents(spark, texts).repartition(3), jaccard.Rule(k, p, 100)).collect())
    assert got == [(i, len(s), want[i]) for i, s in enumerate(sets)]


def test_jaccard_without_table_of_bits(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_NODES", 0)
    texts = near_copies(9)
    _, want = brute_sets(texts, 5, 80, 100)
    docs = documents(spark, texts)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, jaccard.Rule(5, 80, 100)).collect())
    assert got == list(enumerate(want))
    kept = jaccard.first_of_each(docs, jaccard.Rule(5, 80, 100))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_jaccard_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "a b c d e", "", "x y z"], [None, 4, 4, None, 2])
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([(None, 3, None), (4, 3, 4), (4, 3, 4), (None, 0, None), (2, 1, 2)], key=repr)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard.first_of_each(docs).count() == 5


# 7


def test_mixing_meets_targets(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rates, _ = mixing.fit(docs, labels)
    rows = mixing.report(docs, labels).toPandas()
    total = rows.tokens.sum()
    for name in rates.names:
        assert abs((rows.rate * rows.tokens * rows[f"p_{name}"]).sum() / total - mixing.TARGETS[name]) < 1e-3
    assert (rows.rate >= 0).all() and len(rows) == docs.count()
    joined = rows.merge(labels.toPandas(), on="doc_id")
    assert ((joined.p_poor > 0.5) == (joined.quality == 0)).mean() > 0.9
    # the same rates from a plain solver
    p, t, names = rows[[f"p_{n}" for n in rates.names]].to_numpy(), rows.tokens.to_numpy(float), rates.names
    m, want, r = (p * t[:, None]).T @ p, np.array([mixing.TARGETS[n] * total for n in names]), np.ones(len(p))
    for _ in range(200):
        r = np.maximum(0, r - p @ np.linalg.solve(m, p.T @ (t * r) - want))
    assert np.abs(r - rows.rate).max() < 1e-3


def test_mixing_of_awkward_tables(spark):
    docs, labels = documents(spark, AWKWARD), table(spark, "labels")
    assert mixing.report(docs, labels.limit(0)).count() == len(AWKWARD)
    assert mixing.report(docs.limit(0), labels).count() == 0
    out = mixing.mix(docs.withColumn("rate", F.lit("clash")), spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert set(out.columns) == {*docs.columns, "rate", "copies"}
    hard = mixing.report(table(spark, "documents"), labels, {"good": 0.99, "poor": 0.0})
    assert hard.where("rate < 0").count() == 0


# 8


URLS = ["https://www.Example.com/en/1?q#f", "http://x.example.com/en/", "http://example.com/fr", "https://a.net/es/x", "net://es", "http://deep.net", None, "", "no scheme", "http://notexample.com/en/1", "://com/", "http://COM/?x", "http://a.net/fr/é#/x", "http://a.org/en/1", "http://com#a/b"]


def test_url_rules(spark):
    want = []
    for k, u in enumerate(URLS):
        host, path = url_filter.split_url(u)
        fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        want.append((k, host, path, best[1], best[2]))
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = url_filter.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r)[:5] for r in got.collect()) == want
    assert url_filter.judge(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def brute_rules(baskets, bad):
    """Rules by trying every set of tokens, pruned."""
    n, share, z2, rules = len(bad), sum(bad) / len(bad), url_filter.ERRORS**2, {}
    need = max(url_filter.SUPPORT * n, url_filter.LEAST)
    times = Counter(t for b in baskets for t in b)
    every = sorted(t for t in times if times[t] >= need)
    for size in range(1, 6):
        for items in itertools.combinations(every, size):
            m = sum(set(items) <= t for t in baskets)
            hits = sum(b for b, t in zip(bad, baskets) if set(items) <= t)
            if hits >= need:
                c = hits / m
                bound = (c + z2 / (2 * m) - url_filter.ERRORS * math.sqrt(c * (1 - c) / m + z2 / (4 * m * m))) / (1 + z2 / m)
                if c >= url_filter.LIFT * share and bound > share:
                    rules[items] = c
    return {r: c for r, c in rules.items() if not any(set(q) < set(r) and d >= c for q, d in rules.items())}


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    urls, bad = [], []
    for k in range(400):
        spam = rng.random() < 0.2
        urls.append(f"http://{'casino' if spam and rng.random() < 0.9 else rng.choice(['news', 'shop', 'blog'])}.example.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'de'])}/{k}")
        bad.append(int(spam))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - b, 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    baskets = [set(r[0]) for r in df.orderBy("page_id").select(url_filter.tokens(F.col("url"))).collect()]
    mined = url_filter.mine(df, labels)
    rows = mined.collect()
    got = {tuple(r["items"]): r.confidence for r in rows}
    times = Counter(t for b in baskets for t in b)
    assert got == brute_rules(baskets, bad) and got
    assert all(r.anchor == min(r["items"], key=lambda t: (times[t], t)) for r in rows)
    verdict = {r.page_id: r.mined for r in url_filter.judge(df, labels, (), mined).collect()}
    assert all(verdict[k] == any(set(i) <= baskets[k] for i in got) for k in verdict)
    # nothing to learn from pages of one kind
    assert url_filter.mine(df, labels.where("quality = 1")).count() == 0


def test_rules_are_mined_and_used_on_the_given_tables(spark):
    source, labels = table(spark, "pages"), table(spark, "labels")
    mined = url_filter.mine(source, labels)
    items = [set(r["items"]) for r in mined.collect()]
    out = {r.page_id: r for r in url_filter.judge(source, labels, mined=mined).collect()}
    tokens = {r.page_id: set(r[1]) for r in source.select("page_id", url_filter.tokens(F.col("url"))).collect()}
    assert {k for k, r in out.items() if r.mined} == {k for k, t in tokens.items() if any(i <= t for i in items)}
    assert all(r.verdict == ("block" if r.mined else "allow") for r in out.values() if r.rule is None)


def test_long_urls_with_many_common_tokens(spark):
    long = "http://h.example/" + "/".join(f"part{chr(97 + k)}x" for k in range(26)) * 2
    df = spark.createDataFrame([(k, long if k % 2 else f"http://x{k}.example/a") for k in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    out = url_filter.judge(df, labels, ()).collect()
    assert {r.verdict for r in out if r.page_id % 2} == {"block"} and {r.verdict for r in out if not r.page_id % 2} == {"allow"}


def test_tokens_beyond_the_most_frequent_are_mined(spark, monkeypatch):
    """Rare tokens of long URLs make rules, those of nested folders and of folders that stand together too."""
    rng = np.random.default_rng(8)
    urls, bad = [], []
    for k in range(300):
        spam = rng.random() < 0.3
        nested = "/".join(f"deep{chr(97 + j)}" for j in range(int(rng.integers(12, 22))))
        odd = "/".join(f"mix{chr(97 + j)}" for j in range(4) if rng.random() < 0.5)
        urls.append(f"http://a.example/{nested}/{odd}/{'winx/winy' if spam and rng.random() < 0.8 else 'calm'}")
        bad.append(int(spam))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - b, 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    baskets = [set(r[0]) for r in df.orderBy("page_id").select(url_filter.tokens(F.col("url"))).collect()]
    found = url_filter.mine(df, labels).collect()
    assert {("p:winx",), ("p:winy",)} <= {tuple(r["items"]) for r in found}
    times = Counter(t for b in baskets for t in b)
    for r in found:
        m, hits = sum(set(r["items"]) <= b for b in baskets), sum(x for x, b in zip(bad, baskets) if set(r["items"]) <= b)
        assert r.confidence == hits / m and hits >= url_filter.LEAST and r.anchor == min(r["items"], key=lambda t: (times[t], t))
    verdict = {r.page_id: r.mined for r in url_filter.judge(df, labels, ()).collect()}
    assert all(verdict[k] for k, u in enumerate(urls) if "win" in u)
    # the way for long baskets finds the rules of brute force
    small = [f"http://{'casino.club' if b and rng.random() < 0.9 else rng.choice(['news', 'shop', 'blog'])}.org/{rng.choice(['en', 'de'])}/{k}" for k, b in enumerate(bad)]
    df = spark.createDataFrame(list(enumerate(small)), "page_id long, url string")
    baskets = [set(r[0]) for r in df.orderBy("page_id").select(url_filter.tokens(F.col("url"))).collect()]
    monkeypatch.setattr(url_filter, "TOKENS", 1)
    assert {tuple(r["items"]): r.confidence for r in url_filter.mine(df, labels).collect()} == brute_rules(baskets, bad)


# 9


def article(page):
    import html

    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner)]
    return " ".join(b for b in blocks if b)


def test_articles_are_extracted_whole(spark):
    source = table(spark, "pages")
    want = {r.page_id: article(r.html) for r in source.collect()}
    rows = html_text.extract(source).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
    # nor does the text depend on the element that the model was taught by
    model = html_text.fit(source)
    for r in source.collect():
        assert model.extract(re.sub("<(/?)article", r"<\1div", r.html)) == model.extract(re.sub("</?article>", "", r.html)) == want[r.page_id]


def test_odd_pages(spark):
    model = html_text.fit(table(spark, "pages"))
    body = "<p>Long text, with commas, and a full stop. Another sentence follows here, and it is long enough to count.</p>"
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>T&amp;T</h1>{body}<div class='comments'><p>Nice, very nice. Thanks.</p></div><aside>Ad</aside><p>a<b>b</b>&nbsp;c<br>d</article><footer>f</footer>"
    assert model.extract(page) == "T&T " + re.sub("<[^>]*>", "", body) + " ab c d"
    assert model.extract("<article><p>kept<script>var x='</p>'</script><style>p{}</style><!-- no --> too</article>") == "kept too"
    for odd in (None, "", "plain", "<", "<<<>>>", "<p", "</p></p>", "<!--", "<script>", "<article>" * 3000 + "deep", "&#x110000;&#0;&bogus;"):
        assert isinstance(model.extract(odd), str)
    df = pages(spark, [None, "", "<article>x</article>", "<article>x</article>"], [None, 1, 2, 2])
    assert sorted((r.text, r.n_chars) for r in html_text.extract(df, model).collect()) == [("", 0), ("", 0), ("x", 1), ("x", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


LONG = "<p>Long text, with commas, and a full stop. Another sentence follows here, and it is long enough to count.</p>"


def whole(inner):
    return f"<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>{inner}<footer><p>Copyright 2020. All rights reserved.</p></footer></body></html>"


@pytest.mark.parametrize(
    "inner",
    ["<div class='content'>@</div>", "<div>@</div>", "@", "<main>@</main>", "<article class='post ad-free'>@</article>", "<article class='post social-story'>@</article>", "<article><section id='legal-history'>@</section></article>", "<div id=wrap><div class=left>@</div></div>",
     "<article>@</article><div class='sidebar-left'><div><p>Read this too, it is long, and has commas. Yes.</p></div></div>", "<div id=content>@</div><section id=comments><h3>3 comments</h3><div><p>Great, really great post. Thank you.</p></div></section>", "<div>@</div><ul><li><a href=a>One link here</a></li><li><a href=b>Another link here</a></li></ul>"],
)
def test_pages_of_other_forms(spark, inner):
    text = re.sub("<[^>]*>", "", LONG)
    model = html_text.fit(table(spark, "pages"))
    assert model.extract(whole(inner.replace("@", LONG + LONG))) == f"{text} {text}"


def test_without_a_page_to_learn_from(spark):
    text = re.sub("<[^>]*>", "", LONG)
    df = pages(spark, [whole(f"<div>{LONG}{LONG}</div>"), None])
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", f"{text} {text}"]


def test_open_quotes_and_deep_pages(spark):
    model = html_text.fit(table(spark, "pages"))
    assert model.extract(f'<article><p title="abc>broken</p>{LONG}</article>') == "broken " + re.sub("<[^>]*>", "", LONG)
    began = time.time()
    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<p><button>" + "<b>" * 50_000 + "<div>" * 50_000, "<ul>" + "<li>x" * 50_000, "<p>" + "x <a href=y>z</a> " * 50_000):
        model.extract(page)
    assert time.time() - began < 60


def test_weights_are_learned_and_attributes_read_by_whole_name(spark):
    for mark in ("style='overflow:hidden'", "href='/hidden-gems'", "class='overflow-hidden'", "class='post comments-open'", "data-role=menu", "aria-hidden=false", "title='a class=nav b'", "class=no-sidebar", "class=search-method"):
        assert not html_text.Page(f"<div {mark}>x</div>").boiler(1), mark
    for mark in ("hidden", "class='x' HIDDEN=''", "class='site-footer'", "id=sidebarLeft", "ROLE=navigation", "class=comments", "class=cookie-banner"):
        assert html_text.Page(f"<div {mark}>x</div>").boiler(1), mark
    # evidence of boilerplate over content comes from the counts
    model = html_text.fit(table(spark, "pages"))
    assert all(3 < model.known[f][0] - model.known[f][1] < 20 for f in ("tag=nav", "names=boiler"))
    named = html_text.fit(pages(spark, [f"<article><div class=zig>{LONG}</div></article><div class=zag><p>{k}</p></div>" for k in range(20)]))
    assert named.known["word=zag"][0] > named.known["word=zag"][1] and named.known["word=zig"][1] > named.known["word=zig"][0]
    short = "<p>Kept, all of it. Short.</p>"
    for mark in ("style='overflow:hidden'", "class='post comments-open'"):
        assert model.extract(f"<body><nav><a href=x>Home</a></nav><article {mark}>Own text, too. {short}</article></body>") == "Own text, too. Kept, all of it. Short."


def test_raw_elements_end_where_they_do_in_the_page():
    page = html_text.Page("\u0130" * 30 + "<ScRiPt>var x = '<p>';</sCrIpT><p>kept text of the article</p><p>more</p>")
    assert [t for _, t, _ in page.pieces] == ["\u0130" * 30, "kept text of the article", "more"]


def test_tree_marginals_equal_enumeration(spark):
    model = html_text.fit(table(spark, "pages"))
    page = html_text.Page("<body><nav><a>x</a></nav><article><p>Text, here.</p><p>b</p></article></body>")
    got = model.marginals(page)
    n, evidence = len(page.tag), [model.evidence(fs) for fs in page.evidence()]
    edge = [model.edge(page, k) for k in range(n)]
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product(range(3), repeat=n - 1):
        y = (2, *y)
        w = math.prod(edge[k][y[page.parent[k]]][y[k]] * evidence[k][y[k]] for k in range(1, n))
        total += w
        mass += w * (np.array(y) == 1)
    assert np.allclose(mass / total, got, atol=1e-9)


# 10


def brute_hits(texts, items, width=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    known = {}
    for item, t in items:
        w = pattern.findall(low(t or ""))
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            known.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for key, t in enumerate(texts):
        w, hit, ids = pattern.findall(low(t or "")), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if (found := known.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    ids |= {x for x in found if x is not None}
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    long = " ".join(f"t{k}" for k in range(40))
    items = [(1, long), (2, "short item"), (10, "Short-Item"), (3, None), (4, ""), (None, "nobody knows"), (5, " ".join(f"t{k}" for k in range(5, 20))), (5, long)]
    texts = [*AWKWARD, "x " + " ".join(f"T{k}" for k in range(8, 25)) + " y short item z", "nobody knows", "t0 t1 t2", long]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    want = brute_hits(texts, items)
    assert sorted(tuple(r) for r in decontaminate.report(docs, bench).collect()) == want
    plain = sorted((r.key, r.n_words, str(r.spans), str(r["items"])) for r in decontaminate.scan(docs, bench).collect())
    assert sorted((r.key, r.n_words, str(r.spans), str(r["items"])) for r in decontaminate.scan(docs, bench, part=150).collect()) == plain
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, *_, bad in want if not bad] and kept.columns == docs.columns
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, most=0.9).collect()}
    assert cut[10].text == "x  y  z" and cut[10].n_chars == 7 and cut[0].text is None
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


# all


CLASH = "gone _gone bins _bins posterior _posterior fitted rate copies n_words spans items n node place sig salt score key tokens mined".split()


def test_columns_of_any_names_and_empty_tables(spark):
    """Operators read their own columns only, and stages keep all others."""
    docs = documents(spark, [*AWKWARD, "w " * 3000, "same text of some words here", "same text of some words here"])
    wide = docs.select("*", *(F.lit("clash").alias(c) for c in CLASH))
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "of some words")], "item_id long, text string")
    runs = {
        "op2": lambda d: toxicity.scores(d, labels),
        "op3": token_counts.section_tokens,
        "op6": lambda d: jaccard.jaccard_components(d, jaccard.Rule(5, 80, 100)),
        "op7": lambda d: mixing.report(d, labels),
        "op10": lambda d: decontaminate.report(d, bench),
    }
    for name, run in runs.items():
        assert sorted(map(repr, run(docs).collect())) == sorted(map(repr, run(wide).collect())), name
        assert run(docs.limit(0)).count() == 0, name
    stages = {"op2": lambda d: toxicity.drop_toxic(d, labels), "op6": lambda d: jaccard.first_of_each(d, jaccard.Rule(5, 80, 100)), "op10": lambda d: decontaminate.decontaminate(d, bench)}
    for name, run in stages.items():
        out = run(wide)
        assert out.columns == wide.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in run(docs).collect()), name
    assert set(mixing.mix(wide, labels).columns) == set(wide.columns)
    html = pages(spark, ["<article><p>x, y. z</p></article>", None])
    assert sorted(map(repr, html_text.extract(html).collect())) == sorted(map(repr, html_text.extract(html.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))).collect()))
    turns = spark.createDataFrame([(0, 0, "user", "a"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, preference.format_pairs(preference.neighbours(turns)).collect())) == sorted(map(repr, preference.format_pairs(preference.neighbours(turns.withColumn("part", F.lit(1)).withColumn("pair_id", F.lit(9)))).collect()))


def test_a_very_long_text_goes_through_all(spark):
    rng = np.random.default_rng(3)
    long = " ".join(rng.choice([f"word{k}" for k in range(5000)], 400_000))  # about 3.5 MB
    docs = documents(spark, [long, long + " more", "short text"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_020]))], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(docs, bench).orderBy("doc_id").collect()] == [20, 20, 0]
    assert [r.component_id for r in jaccard.jaccard_components(docs, jaccard.Rule(5, 80, 100)).orderBy("doc_id").collect()] == [0, 0, 2]
    assert toxicity.scores(docs, labels).count() == 3 and mixing.report(docs, labels).count() == 3
    model = html_text.fit(table(spark, "pages"))
    assert model.extract(f"<article><p>{long}</p></article>") == long


def test_exact_comparison_of_vectors_agrees(spark):
    rows = table(spark, "embeddings").select("vec_id", "embedding", "label")
    near = rows.select(F.col("vec_id") + 100_000, F.transform("embedding", lambda x, i: x + F.when(F.pmod(i, F.lit(7)) == 0, 0.02).otherwise(0.0)).cast("array<float>"), "label")
    rows = rows.unionByName(near.toDF(*rows.columns))
    a, b = (sorted(tuple(r) for r in embedding_dedup.near_duplicates(rows, exact=x).collect()) for x in (False, True))
    assert a == b and any(r[1] for r in a)


# pipeline


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
            rows = {r.doc_id: r.text for r in docs.collect()}
            kept = {r.doc_id: r.text for r in out.collect()}
            assert kept.items() <= rows.items()
        if k == 1:
            ids = sorted(rows)
            _, want = brute_sets([rows[i] for i in ids], 5, 80, 100)
            assert sorted(kept) == sorted({ids[w] for w in want})
        if k == 2:
            items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
            ids = sorted(rows)
            assert sorted(kept) == [ids[h[0]] for h in brute_hits([rows[i] for i in ids], items) if not h[-1]]
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.columns == [*columns, "rate", "copies"] and docs.where("rate <= 0").count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
