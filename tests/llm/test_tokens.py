"""Byte-pair encoding against tiktoken, alignment and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loanscope.llm import byte_bpe, importance_resampling, queries, token_alignment


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.build(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.tokens, special_tokens={})


def odd_texts(ranks=None):
    rng = random.Random(11)
    alphabet = "ab c1 \n\t.,'sèéßЖ漢字😀\x85\xa0\x1c\x00" + (ranks.unknown[:4] if ranks else "")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["x" * 3000, "ab" * 700, " " * 900, "\n" * 600, "漢字" * 200, "<|endoftext|> it's </s> <0x41>", "a▁b", " lead", "trail ", "two  spaces\n in one", "\n", " "]
    texts += ["".join(rng.choice("aeiontrs") for _ in range(n)) for n in (2, 3, 511, 512, 513, 900)]
    return texts


def test_encoding_matches_tiktoken_and_decodes(spark, docs, corpus, ranks, library):
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd_texts(ranks))], "doc_id long, text string")
    rows = docs.withColumnRenamed("found", "token_ids").unionByName(more, allowMissingColumns=True)
    encoded = byte_bpe.encode(rows, ranks)
    assert encoded.columns == [c for c in rows.columns if c != "token_ids"] + ["token_ids"]
    decoded = byte_bpe.decode(encoded, ranks).collect()
    assert len(decoded) == rows.count()
    for r in decoded:
        assert list(r.token_ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(rows, ranks, keep_text=False).columns == [c for c in rows.columns if c not in ("token_ids", "text")] + ["token_ids"]


def test_registered_encoding(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op11_byte_level_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pieces_are_forgotten_within_bounds(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    encoder = byte_bpe.Encoder(ranks)
    for t in odd_texts(ranks):
        ids, offsets = encoder.encode([t, None, t])
        want = library.encode_ordinary(t)
        assert ids.tolist() == want * 2 and offsets.tolist() == [0, len(want), len(want), 2 * len(want)]


@pytest.mark.parametrize("seed", range(4))
def test_merges_of_any_vocabulary(seed):
    """Ranks in any order: a merge may bring forth a pair of smaller rank."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)}
    order = rng.sample(sorted(words), len(words))
    vocabulary = {bytes([b]): b for b in range(256)} | {w.encode(): 256 + i for i, w in enumerate(order)}
    ranks = byte_bpe.build(vocabulary, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    for n in (1, 2, 5, 17, 90, 600):
        for _ in range(20):
            text = "".join(rng.choice("abc") for _ in range(n))
            want = library.encode_ordinary(text)
            matrix, _ = byte_bpe.encode_pieces(ranks, [text.encode()])
            assert matrix.tolist() == want
            if text.encode() not in vocabulary:
                assert byte_bpe.merge_long(ranks, ranks.byte_ids[np.frombuffer(text.encode(), np.uint8)]).tolist() == want


def test_encoding_edges(spark, no_docs, ranks):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, ranks), ranks).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 50255])], "id long, token_ids array<int>")
    got = {r.id: r.decoded for r in byte_bpe.decode(lists, ranks).collect()}
    by_id = {i: t for t, i in ranks.tokens.items()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == by_id[0] + by_id[50255]
    for bad in ([None], [50256], [-1]):
        with pytest.raises(Exception, match="token id"):
            byte_bpe.decode(spark.createDataFrame([(1, bad)], "id long, token_ids array<int>"), ranks).collect()


# alignment

@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.read_tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows, contents):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) from the libraries and the definition."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(contents.first), SentencePieceProcessor(model_proto=contents.second)
    first.encode_special_tokens = True
    as_byte = token_alignment.byte_of_characters()

    def a_bytes(i):
        return bytes(as_byte[c] for c in first.id_to_token(i))

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    aligned, counts = [], Counter()
    for d, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a = b = []
        groups, links, i, j, x, y = [], [], 0, 0, 0, 0
        while i < len(a):
            ga, gb = [], []
            while not ga or x != y:
                if x <= y:
                    ga.append(a[i]); x += len(a_bytes(a[i])); i += 1
                else:
                    gb.append(b[j]); y += len(b_bytes(b[j])); j += 1
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
        counts.update(links)
        aligned.append((d, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, n_a, n_b, groups, links in aligned:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return Counter(out)


def text_digest(r):
    groups, i, j = [], 0, 0
    for n, m in zip(r.a_sizes, r.b_sizes):
        groups.append(",".join(map(str, r.a_ids[i : i + n])) + "|" + ",".join(map(str, r.b_ids[j : j + m])))
        i, j = i + n, j + m
    assert (i, j) == (len(r.a_ids), len(r.b_ids))
    return hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""


@pytest.mark.parametrize("share", [0.0, 1e-3, 2.0])
def test_alignment_matches_brute_force(spark, docs, corpus, tokenizers, share):
    odd = [(10_000 + i, t) for i, t in enumerate(odd_texts(byte_bpe.Ranks({}, *[None] * 6, "".join(byte_bpe.unassigned_words()[:4])))[::3])]
    rows = docs.select("doc_id", "text", "lang", "n").unionByName(
        spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, lang string, n long")).repartition(4)
    linked = token_alignment.staged(token_alignment.align_links(rows, tokenizers), "test-alignment")
    got = token_alignment.link_scores(linked, token_alignment.link_counts(linked), share=share)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([*corpus, corpus[0], *odd], tokenizers)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(r[1] == 0 for r in want) and any(r[3] < r[1] for r in want)
    if share:
        return
    aligned = token_alignment.align(rows, tokenizers).collect()
    assert Counter((r.doc_id, len(r.a_ids), len(r.b_ids), len(r.a_sizes), text_digest(r)) for r in aligned) == Counter((*r[:4], r[7]) for r in want.elements())


def test_pointer_jumping_finds_long_groups():
    """Tokens of two bytes against tokens of two bytes shifted by one: one group of a million tokens."""
    n = 500_000
    a, b = np.full(n, 2), np.concatenate([[1], np.full(n - 1, 2), [1]])
    a_group, b_group = token_alignment.groups(a, b)
    assert set(a_group) == {0} and set(b_group) == {0}
    a_group, b_group = token_alignment.groups(np.array([1, 2, 3, 1]), np.array([3, 1, 1, 1, 1]))
    assert a_group.tolist() == [0, 0, 1, 2] and b_group.tolist() == [0, 1, 1, 1, 2]


def test_links_of_large_vocabularies_are_packed():
    links = np.array([70_000 << 32 | 5, 3 << 32 | 99_999, 1 << 32 | 2])
    for some in (links, links[2:], links[:0]):
        edges = np.array([0, 0, len(some), len(some)])
        back, at = token_alignment.unpacked_links(token_alignment.pa.array(token_alignment.packed_links(some, edges)))
        assert back.tolist() == some.tolist() and at.tolist() == edges.tolist()


def test_alignment_edges(spark, no_docs, tokenizers):
    empty = token_alignment.align_links(no_docs, tokenizers)
    assert token_alignment.align(no_docs, tokenizers).count() == 0
    assert token_alignment.link_scores(empty, token_alignment.link_counts(empty)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (2, "a▁b")], "doc_id long, text string")
    linked = token_alignment.align_links(rows, tokenizers)
    got = sorted((tuple(r)[:4] for r in token_alignment.link_scores(linked, token_alignment.link_counts(linked)).collect()), key=str)
    assert got == sorted([(None, 2, 2, 2), (None, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)], key=str)


# resampling

def brute_resampling(rows, target, order, buckets, least, percent, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    total, aims = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aims + buckets)))) for b in range(buckets)]
    scored, able = [], []
    for d, x in rows:
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        able.append(len(w) >= least)
    order_ = sorted((i for i in range(len(rows)) if able[i]),
                    key=lambda i: (-scored[i][3], (0, 0) if scored[i][0] is None else (1, scored[i][0]), scored[i][1]))
    rank = {i: n + 1 for n, i in enumerate(order_[: len(order_) * percent // 100])}
    return Counter((*scored[i], rank.get(i)) for i in range(len(rows)))


@pytest.mark.parametrize("order, buckets, percent", [(1, 10_000, 10), (2, 500, 60), (3, 300, 100)])
def test_resampling_matches_brute_force(spark, docs, corpus, order, buckets, percent):
    rng = random.Random(8)
    lines = ["\n".join(" ".join(rng.choice(["Stone", "river", "no", "7", "é"]) for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 12)))
             for _ in range(40)]
    more = [(20_000 + i // 2, t) for i, t in enumerate(lines)] + [(None, "river stone " * 20), (None, None), (7, "lamp\n\n\n  \ntree\n-\nwind"), (8, "\n")]
    target = ["the river and the stone\nlamp", None, "", "wind salt\nroad"]
    rows = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, key long"))
    got = importance_resampling.resample(rows, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"),
                                         order, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resampling([*corpus, corpus[0], *more], target, order, buckets, 20, percent)


def test_resampling_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance_resampling.resample(no_docs, none).count() == 0
    assert importance_resampling.resample(docs, none).count() == docs.count()
    copies = spark.range(300).selectExpr("5L AS doc_id", "repeat('river ', 30) AS text")
    ranks = [r["rank"] for r in importance_resampling.resample(copies, none).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 31)) and ranks.count(None) == 270


def test_tasks_of_a_worker_go_on_with_known_words(tokenizers):
    """The second task of a process encodes no word again that the first one has met."""
    texts = ["some words that come again", "and again some words"]
    first = token_alignment.aligner_of(tokenizers)
    whole = first.align(texts)
    known = len(first.first.encoder.number), len(first.second.number)
    again = token_alignment.aligner_of(tokenizers)
    assert again is first and token_alignment.digests(again.align(texts)) == token_alignment.digests(whole)
    assert (len(again.first.encoder.number), len(again.second.number)) == known


def test_texts_of_known_words_are_not_encoded_again(tokenizers, monkeypatch):
    """Each word is aligned once; texts of its words alone take its groups, other texts are aligned as a whole, in the order of the texts."""
    texts = ["river's bank,\nagain", "", "two  spaces", " bank", "again river's bank", "line \nbreak", "<s> x", "\t", "¹ é", "bank again"]
    aligner = token_alignment.Aligner(tokenizers)
    whole = aligner.whole(texts, aligner.first.encode, aligner.second.encode)
    for _ in range(2):
        links, placed = aligner.links(texts), aligner.align(texts)
        assert links.digests == token_alignment.digests(whole) == token_alignment.digests(placed)
        assert links.packed == token_alignment.packed_links(whole.links(), whole.edges)
        assert links.n_a.tolist() == np.diff(whole.a_edges).tolist() and links.n_b.tolist() == np.diff(whole.b_edges).tolist()
        assert all((getattr(placed, f) == getattr(whole, f)).all() for f in ("a", "a_edges", "b", "b_edges", "a_sizes", "b_sizes", "edges"))
    monkeypatch.setattr(aligner, "whole", None)  # asked for nothing more
    known = [t for t, there in zip(texts, aligner.placed(texts)[0]) if there]
    assert len(known) >= 3 and aligner.links(known).n_groups.tolist() == aligner.links(known[::-1]).n_groups.tolist()[::-1]
