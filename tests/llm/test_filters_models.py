"""Decontamination, URL filters, toxicity, language model, mixing, archives."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanscope.llm import common, decontaminate, mixing, ppm, toxicity, url_filters, warc
from tests.llm.conftest import prose


def shingles(text, n=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


@pytest.fixture(scope="module")
def items(spark, corpus):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (3, 5, 14, 30, 59)]
    whole = corpus[4][1].split(" ")
    texts += [" ".join(whole[2:30]), " ".join(whole[0:12] + ["other"] + whole[12:40]), None, "", "one", "two words"]
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_contamination_matches_brute_force(spark, docs, corpus, items):
    table = spark.createDataFrame(items, "item_id long, text string, hash string")
    want = {}
    for d, t in corpus:
        for i, s, _ in items:
            a, b = shingles(s), shingles(t)
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want[d, i] = (len(a), len(a & b))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.contamination(docs, table).collect()}
    assert got == want and len(want) > 3
    left = decontaminate.decontaminate(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in corpus} - {d for d, _ in want}


def test_contamination_of_nothing(spark, docs, no_docs, items):
    table = spark.createDataFrame(items, "item_id long, text string, hash string")
    assert decontaminate.contamination(no_docs, table).count() == 0
    assert decontaminate.decontaminate(docs, table.limit(0)).count() == docs.count()


def test_decontamination_is_native(docs, spark, items):
    table = spark.createDataFrame(items, "item_id long, text string, hash string")
    plan = decontaminate.contamination(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def page_rank(edges, seeds, damping, rounds):
    out = Counter(a for a, _ in edges)
    rank = dict(seeds)
    for _ in range(rounds):
        new = Counter({h: m * (1 - damping) for h, m in seeds.items()})
        for a, b in edges:
            new[b] += damping * rank.get(a, 0) / out[a]
        rank = dict(new)
    return rank


URLS = [
    ("https://good.org/fr/1", '<a href="https://a.example.com/x">'), ("http://spam.net/", "<a href='//b.example.com/'>"),
    ("https://b.example.com/en/2?x=/de/", '<a HREF=http://Spam.net:80/ ><img src="//spam.net/i">'),
    ("https://a.example.com/de/5#t", None), ("https://a.example.com/e", '<a href="https://good.org/">'),
    ("HTTP://WWW.Example.NET/en/7", ""), ("https://c.com", '<a href="http://spam.net">'), ("https://xnet/fr/", ""), (None, "x"),
    ("no scheme", "y"), ("https://org/fr/", ""), ("ftp://É.org/fr/a", ""), ("https://a.example.com/e", '<a href="https://good.org/">'),
]


def test_url_rules_and_propagation(spark):
    pages = spark.createDataFrame([(i, u, h, "extra") for i, (u, h) in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filters.filter_urls(pages).collect()}
    assert len(got) == len(URLS)
    expect = {0: ("good.org", "/fr/1", "org/fr/", "allow"), 1: ("spam.net", "/", "net/", "block"),
              3: ("a.example.com", "/de/5", "example.com/de/", "block"), 5: ("www.example.net", "/en/7", "example.net/en/", "allow"),
              7: ("xnet", "/fr/", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
              10: ("org", "/fr/", "org/fr/", "allow"), 11: ("É.org", "/fr/a", "org/fr/", "allow")}
    for i, want in expect.items():
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == want, i
    assert got[2].verdict == "block" and got[6].verdict == "block"  # they link to a blocked host
    assert got[4].verdict == "allow" and got[2].path == "/en/2" and got[6].path == ""
    edges = {("good.org", "a.example.com"), ("spam.net", "b.example.com"), ("b.example.com", "spam.net:80"), ("b.example.com", "spam.net"),
             ("a.example.com", "good.org"), ("c.com", "spam.net")}
    trusted = {"good.org": 1, "www.example.net": 1, "org": 1, "É.org": 1}
    trust = page_rank(edges, {h: m / 4 for h, m in trusted.items()}, 0.85, 12)
    distrust = page_rank({(b, a) for a, b in edges}, {"spam.net": 0.5, "www.example.net": 0.0}, 0.85, 12)
    assert got[4].trust == pytest.approx(trust["a.example.com"])
    assert got[6].distrust == pytest.approx(2 * distrust["c.com"], rel=1e-6)
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_toxic_texts_are_found(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        w = prose(rng, 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["hatefulx", "vilething", "scumbag"]))
        rows.append((i, " ".join(w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = table.select("doc_id", "text", F.lit(1).alias("score")).unionByName(
        spark.createDataFrame([(-1, None, 1), (-2, "", 1), (None, "a b", 1)], "doc_id long, text string, score int"))
    model = toxicity.train(docs, table.select("doc_id", "toxic"), common.crc_fold("doc_id") != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[-1].score == got[-2].score and len(got) == len(rows) + 3
    none = toxicity.train(docs, table.limit(0).select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def labelled(seed, flips=0, separable=True, n=800):
    """(ordinary, toxic) for training, with mislabelled toxic texts among the ordinary, and the same held out, all labels right."""
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(1500)]
    bad = ["".join(rng.choice("klmnop") for _ in range(7)) for _ in range(12)]

    def text(toxic):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if toxic and separable:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    ordinary = [text(i < flips) for i in range(n)]
    rng.shuffle(ordinary)
    return ordinary, [text(True) for _ in range(n)], [text(False) for _ in range(400)], [text(True) for _ in range(400)]


@pytest.mark.parametrize("seed, flips", [(0, 0), (1, 4), (2, 8), (3, 8)])
def test_mislabelled_rows_do_not_spoil_the_model(seed, flips):
    ordinary, toxic, clean, bad = labelled(seed, flips)
    model = toxicity.fit(ordinary, toxic)
    rejected, found = (np.mean(toxicity.score_texts(*toxicity.buffer_of(x), model) >= 0.5) for x in (clean, bad))
    assert found >= 0.9 and rejected <= 0.05


def test_classes_that_nothing_separates_reject_nothing():
    for seed in (0, 5):
        ordinary, toxic, clean, _ = labelled(seed, separable=False)
        model = toxicity.fit(ordinary, toxic)
        assert not (toxicity.score_texts(*toxicity.buffer_of([*clean, ""]), model) >= 0.5).any()
    same = ["one text"] * 40
    assert not (toxicity.score_texts(*toxicity.buffer_of(same), toxicity.fit(same, same)) >= 0.5).any()


def test_safe_cut():
    y = np.array([0, 0, 0, 1, 1])
    assert toxicity.safe_cut(np.array([1.0, 2, 3, 8, 9]), y) == 5.5
    assert toxicity.safe_cut(np.zeros(5), y) == 1.0
    assert toxicity.safe_cut(np.array([1.0, 9, 9.5, 8, 2]), y) > 9.5


def test_toxic_rows_go_with_all_their_columns(spark):
    ordinary, toxic, clean, bad = labelled(6, n=300)
    rows = [(i, t, int(i >= 300), "x", [i]) for i, t in enumerate(ordinary + toxic)] + [(None, bad[0], 1, "x", None), (9999, None, 0, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string, part array<int>")
    left = toxicity.drop_toxic(docs, docs.select("doc_id", F.col("score").alias("toxic")))
    assert left.schema == docs.schema
    kept = [tuple(r) for r in left.collect()]
    model = toxicity.train(docs, docs.select("doc_id", F.col("score").alias("toxic")), common.crc_fold("doc_id") != 0)
    dropped = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted and r.doc_id is not None}
    assert sorted(kept, key=str) == sorted((r for r in rows if r[0] not in dropped), key=str) and 250 < len(dropped) < 320
    assert toxicity.drop_toxic(docs.limit(0), docs.select("doc_id", F.col("score").alias("toxic"))).count() == 0


def test_long_texts_train_by_pieces_and_score_whole(spark):
    ordinary, toxic, clean, bad = labelled(4, n=300)
    rows = [(i, t, 0) for i, t in enumerate(ordinary)] + [(1000 + i, t, 1) for i, t in enumerate(toxic)]
    rows += [(2000 + i, " ".join(bad[:60]), 1) for i in range(5)] + [(3000, " ".join(clean * 3), 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert max(len(r[1]) for r in rows) > toxicity.SAMPLE_TEXT_BYTES
    model = toxicity.train(table, table.select("doc_id", "toxic"))
    longs = spark.createDataFrame([(1, " ".join(clean * 5), 0), (2, " ".join(clean * 5 + bad[:40]), 1), (2, "x", 3)], "doc_id long, text string, predicted int")
    got = sorted((r.doc_id, r.predicted) for r in toxicity.score(longs, model).collect())
    assert len(got) == 3 and (1, 0) in got
    again = toxicity.train(table.union(table.limit(50)), table.select("doc_id", "toxic"))
    assert again.weights


def brute_probability(train, text, order):
    """Prediction by partial matching from its definition, byte by byte, without pruning."""
    counts = {}
    for t in train:
        s = [ppm.END] * order + list(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    s, total = [ppm.END] * order + list(text), 0.0
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -2, -1):
            if k < 0:
                total -= math.log10(256 - len(excluded))
                break
            seen = {b: n for b, n in counts.get(tuple(s[i - k : i]), {}).items() if b not in excluded}
            if not seen:
                continue
            n = sum(seen.values())
            if s[i] in seen:
                total += math.log10((seen[s[i]] - 0.5) / n)
                break
            total += math.log10(len(seen) / (2 * n))
            excluded |= set(seen)
    return total


def stream(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return "".join(w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", low)).encode() + b"\n"


@pytest.mark.parametrize("word_share", [2e-6, 0.02])
def test_language_model_matches_its_definition(docs, corpus, word_share):
    train = docs.filter(common.crc_fold("doc_id") != 1)
    model = ppm.train(train, order=3, context_share=0.0, word_share=word_share)
    seen = [t for d, t in corpus + [corpus[0]] if zlib.crc32(str(d).encode()) % 5 != 1]
    tokens = Counter(w for t in seen for w in stream(t).decode().split())
    n, v = sum(tokens.values()) + len(seen), len(tokens) + 1
    assert (model.tokens, model.distinct) == (n, v)
    got = ppm.score(docs, model).collect()
    assert len(got) == len(corpus) + 1
    texts = dict(corpus)
    for r in got:
        w = stream(texts[r.doc_id]).decode().split()
        base = sum(math.log10((tokens[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((len(seen) + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(x in tokens for x in w) + 1)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(brute_probability([stream(t) for t in seen], stream(texts[r.doc_id]), 3), rel=1e-4)


def test_language_model_without_training(docs, no_docs):
    model = ppm.train(no_docs)
    got = ppm.score(docs, model).collect()
    assert {r.n_known for r in got} == {0}
    assert ppm.score(no_docs, model).count() == 0


def brute_mix(rows, plan, epochs, order):
    taken = set()
    for leaf, budget in plan.items():
        own = [r for r in rows if r[1:4] == leaf and r[4] > 0]
        used = 0
        for e in range(epochs):
            for r in sorted(own, key=lambda r: order[r[0], e]):
                if used < budget:
                    taken.add((r[0], e))
                used += r[4]
    return taken


def test_mix_takes_prefixes_of_epochs(spark, docs, corpus, no_docs):
    weights = {("domain1",): 5.0, ("domain1", "en", "src1"): 3.0}
    got = mixing.mix(docs, 0.9, weights, max_epochs=3).collect()
    sized = docs.distinct().select("doc_id", mixing.default_domain(F.col("source")).alias("d"), "lang", "source",
                                   mixing.token_count(F.col("text")).alias("n"), F.xxhash64("text").alias("k")).collect()
    assert {r.doc_id: r.n for r in sized} == {d: len(stream(t).split()) for d, t in corpus}
    plan = {(r.domain, r.lang, r.source): r.leaf_budget for r in got}
    leaves = Counter()
    for r in sized:
        leaves[r.d, r.lang, r.source] += r.n
    leaves["domain0", "en", "src0"] += 0
    first = corpus[0][0]
    once = [r for r in sized if r.doc_id != first]  # the repeated row is checked by the totals below
    places = spark.createDataFrame([(r.doc_id, r.k, e) for r in sized for e in range(3)], "doc_id long, k long, e int").select(
        "doc_id", "e", F.xxhash64(F.lit(7), "e", "doc_id", "k").alias("h")).collect()
    order = {(r.doc_id, r.e): r.h % (1 << 64) for r in places}
    single = mixing.mix(docs.filter(F.col("doc_id") != first), 0.9, weights, max_epochs=3).collect()
    plan = {(r.domain, r.lang, r.source): r.leaf_budget for r in single}
    rows = [(r.doc_id, r.d, r.lang, r.source, r.n) for r in once]
    assert {(r.doc_id, r.epoch) for r in single} == brute_mix(rows, plan, 3, order)
    assert all(r.n_tokens > 0 for r in got)
    assert mixing.mix(no_docs).count() == 0


def test_shortages_go_to_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    given = mixing.budgets(leaves, 400, lambda p: 1.0, 1)
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    short = mixing.budgets(leaves | {("a", "x", "2"): 20}, 400, lambda p: 1.0, 1)
    assert short == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "1"): 170, ("b", "x", "1"): 200}
    assert sum(mixing.budgets(leaves, 10**9, lambda p: 1.0, 2).values()) == 2 * sum(leaves.values())
    assert mixing.budgets({}, 5, lambda p: 1.0, 1) == {}
    assert mixing.budgets({(None, None, None): 7}, 3, lambda p: 1.0, 1) == {(None, None, None): 3}


def staged_list(written):
    return written.sparkSession.createDataFrame([tuple(r) for r in written.collect()], "archive string, records long, bytes long, content binary")


PAGES = [(1, "http://a/1", "<p>é one</p>"), (2, None, "<p>two</p>"), (3, "http://a/3\r\nX: y", "<p>é one</p>"), (4, "u", None), (5, "u", ""),
         (6, "u", "WARC/1.1\r\nfake: record\r\n\r\n"), (7, "u", "z" * 20000)]


@pytest.mark.parametrize("as_files", [True, False])
def test_archive_round_trip(spark, monkeypatch, as_files):
    monkeypatch.setattr(warc, "opens", lambda folder: as_files)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = warc.new_folder(spark)
    written = warc.write_archives(warc.mark_revisits(pages), folder, archive_bytes=300)
    names = [tuple(r) for r in written.collect()]
    assert sum(n for _, n, _, _ in names) == len(PAGES) and len(names) > 3
    assert all((content is None) == as_files for *_, content in names)
    listed = spark.createDataFrame(names, "archive string, records long, bytes long, content binary")
    rows = {r.page_id: r for r in warc.read_archives(spark, folder, listed).collect()}
    assert len(rows) == len(PAGES)
    for i, _, h in PAGES:
        payload = (h or "").encode()
        last = max(j for j, _, g in PAGES if (g or "") == (h or ""))
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.kind, r.refers_to) == (("revisit", last) if i < last else ("response", None))
        assert r.payload is None if r.kind == "revisit" else bytes(r.payload) == payload
    empty = warc.new_folder(spark)
    assert warc.write_archives(warc.mark_revisits(pages.limit(0)), empty).count() == 0
    assert warc.read_archives(spark, empty).count() == 0


def test_stores_that_tasks_cannot_open():
    assert warc.opens("file:///tmp/x")
    assert not any(map(warc.opens, ("s3a://lake/x", "dbfs:/x", "viewfs://store/x")))


def test_archives_with_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, "u", "one"), (None, "v", "two"), (7, "u", "three"), (7, "u", "three"), (8, "u", "three")],
                                  "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    written = staged_list(warc.write_archives(warc.mark_revisits(pages), folder))
    got = sorted(((r.page_id, r.kind, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder, written).collect()), key=str)
    assert got == sorted([(None, "response", None, 3), (None, "response", None, 3), (7, "revisit", 8, 5), (7, "revisit", 8, 5), (8, "response", None, 5)], key=str)


def test_reading_an_archive_takes_linear_time():
    import time

    member = [warc.compress(warc.build_record(i, "u", p, len(p), warc.payload_digest(p), None))
              for i, p in enumerate(random.Random(3).randbytes(700) for _ in range(200))]

    def seconds(times):
        data = b"".join(member) * times
        start = time.perf_counter()
        assert sum(not isinstance(x, tuple) for x in warc.salvage(data)) == 200 * times
        return time.perf_counter() - start

    seconds(4)
    assert min(seconds(80) for _ in range(2)) < 3 * 8 * min(seconds(10) for _ in range(2))


def test_reader_salvages_damaged_archives():
    records = [warc.build_record(i, f"u{i}", p, len(p), warc.payload_digest(p), None) for i, p in enumerate([b"one" * 50, b"two" * 50, b"three" * 50, b""])]
    members = [warc.compress(r) for r in records]

    def read(data):
        found = list(warc.salvage(data))
        return ([x.headers["warc-record-id"] for x in found if not isinstance(x, tuple)], [x[:2] for x in found if isinstance(x, tuple)])

    ids = [warc.record_id(i) for i in range(4)]
    assert read(b"".join(members)) == (ids, [])
    assert read(b"".join(records)) == (ids, [])
    broken = bytearray(b"".join(members))
    at = len(members[0])
    broken[at + len(members[1]) - 6] ^= 0xFF  # the second member's checksum
    assert read(bytes(broken)) == ([ids[0], ids[2], ids[3]], [(at, at + len(members[1]))])
    junk = members[0] + b"garbage\x1f\x8b\x08not a member" + members[1] + members[2][:-9]
    got, gaps = read(junk)
    assert got == ids[:2] and gaps[0][0] == len(members[0]) and gaps[1][1] == len(junk)
    plain = records[0] + records[1].replace(b"two", b"TWO", 1) + records[2]
    assert read(plain) == ([ids[0], ids[2]], [(len(records[0]), len(records[0]) + len(records[1]))])
    assert read(b"") == ([], []) and read(b"nothing")[1] == [(0, 7)]


def test_streams_of_bytes():
    data, offsets = common.raw_text(pa.array(["Ab  c", None, "é\n"]))
    s, stop, _ = ppm.streams(data, offsets, 2)
    assert bytes(s) == b"\n\nab c \n" + b"\n\n\n" + b"\n\n" + "é \n".encode() and stop.tolist() == [8, 11, 17]


@pytest.mark.parametrize("context_share", [1e-3, 2.0])
def test_rare_contexts_count(spark, context_share):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30)) for i in range(36)] + [(200, None), (201, "Zebra \x00 é never seen")]
    train = [stream(t) for i, t in rows if i < 33]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = ppm.train(docs.filter("doc_id < 33"), context_share=context_share)
    got = ppm.score(docs.filter("doc_id > 30"), model).collect()
    assert len(got) == 7
    for r in got:
        assert r.score == pytest.approx(brute_probability(train, stream(dict(rows)[r.doc_id]), ppm.ORDER), rel=1e-4)
