"""Substring and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.llm import common, line_dedup, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_removed(rows, window):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [21, 35])
def test_removed_words_match_brute_force(docs, corpus, window):
    got = Counter(tuple(r) for r in substring_dedup.remove(docs, window).drop("kept_text").collect())
    assert got == brute_removed(corpus + [corpus[0]], window)


def test_substring_edges(spark, docs, no_docs):
    assert substring_dedup.remove(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, None)], "doc_id long, text string")
    got = {tuple(r[:3]) for r in substring_dedup.remove(odd).collect()}
    assert got == {(None, 2, 0), (None, 0, 0), (1, 0, 0)}
    with pytest.raises(ValueError):
        substring_dedup.remove(docs, 20)


def test_cover_brings_any_two_positions_together():
    for d in range(substring_dedup.PERIOD):
        assert any((c + d) % substring_dedup.PERIOD in substring_dedup.COVER for c in substring_dedup.COVER)


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "ba", "aab", "é", "b"]) for _ in range(50)) for _ in range(20)]
    import pyarrow as pa
    data, offsets = common.raw_text(pa.array(texts + [None, ""]).slice(2))
    starts, ends, first = common.word_bounds(data, offsets)
    h = common.word_hashes(data, starts, ends)
    by_word = {}
    for s, e, x in zip(starts, ends, h):
        by_word.setdefault(bytes(data[s:e]), set()).add(int(x))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    assert np.diff(first).tolist() == [50] * 18 + [0, 0]


def brute_lines(rows):
    """First occurrence of each chunk stays, by document id and position."""
    seen = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, _, _, piece in line_dedup.multi_line_chunks(t or ""):
            seen.setdefault(piece, (d, n))
    out = []
    for d, t in rows:
        gone = [] if d is None else [n for n, _, _, piece in line_dedup.multi_line_chunks(t or "") if seen[piece] != (d, n)]
        out.append((d, t if not gone else line_dedup.without_chunks(t, gone)[0]))
    return Counter(out)


def test_removed_chunks_match_brute_force(docs, corpus):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed_lines"]
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert Counter(rows) == brute_lines(corpus + [corpus[0]])
    assert any(t != dict(corpus)[d] for d, t in rows)


def test_chunks_resist_shifts():
    rng = random.Random(3)
    lines = [f"line {rng.random()}" for _ in range(200)]
    whole = {tuple(lines[a:b]) for a, b, _ in line_dedup.chunk_lines(lines)}
    shifted = ["new", "newer", *lines[:100], "between", *lines[100:]]
    again = {tuple(shifted[a:b]) for a, b, _ in line_dedup.chunk_lines(shifted)}
    assert len(whole & again) >= len(whole) - 4


def test_line_edges(spark, no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    block = "\n".join(f"same {i}" for i in range(12))
    rows = [(1, block), (2, block), (None, block), (3, None), (4, "")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(x for x in got if x[0] is not None)
    assert (None, block) in got and texts[1] == block and len(texts[2]) < len(block) and texts[3] is None and texts[4] == ""


def test_short_passages_are_removed_wherever_they_begin(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        passage = [f"passage {i} {k}" for k in range(2 + i % 4)]
        for side in (0, 1):
            around = [f"own {i} {side} {rng.random()}" for _ in range(1 + i % 3)]
            text = [*around, *passage, *around[::-1][:1], "end"][: None if i % 2 else -2]
            rows.append((2 * i + side, "\n".join(text)))
            want[2 * i + side] = text if side == 0 else [x for x in text if x not in passage]
    rows += [(500, "again\nagain\nagain\nagain"), (None, rows[0][1])]
    want[500], want[None] = ["again", "again"], rows[0][1].split("\n")
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split("\n") for r in got} == want
    assert all(r.n_removed_lines == dict(rows)[r.doc_id].count("\n") - r.text.count("\n") for r in got)


def brute_passages(rows, width):
    """Texts without the lines of runs that have occurred before, by document id and position."""
    first = {}
    def runs(t):
        lines = (t or "").split("\n")
        return [(i, tuple(lines[i : i + width])) for i in range(len(lines) - width + 1) if any(x.strip() for x in lines[i : i + width])]
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for i, run in runs(t):
            first.setdefault(run, (d, i))
    out = []
    for d, t in rows:
        gone = {i + k for i, run in runs(t) if d is not None and (first[run][0] != d or i >= first[run][1] + width) for k in range(width)}
        out.append((d, t if t is None or not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("width", [2, 3])
def test_removed_passages_match_brute_force(spark, docs, corpus, no_docs, width):
    rng = random.Random(6)
    passages = [[f"line {i} of {n}" for i in range(n)] for n in (2, 3, 5, 9)]
    more = []
    for i in range(40):
        lines = [x for _ in range(rng.randrange(1, 4)) for x in [f"own {i} {rng.random()}", *rng.choice(passages)]]
        more.append((50_000 + i, "\n".join(lines)))
    more += [(60_000, "\n".join(f"row {i % 7000}" for i in range(30_000))), (None, more[0][1]), (60_001, None), (60_002, "\n\n")]
    rows = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, key long")).withColumns(
        {"Gone": F.lit("kept"), "gone_id": F.lit(1), "gone_text": F.lit(2), "runs": F.lit(3), "text_hash": F.lit(4)})
    out = line_dedup.dedup_passages(rows, width)
    assert out.columns == [*rows.columns, "n_removed_lines"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_passages([*corpus, corpus[0], *more], width)
    assert {(r.Gone, r.gone_id, r.gone_text, r.runs, r.text_hash) for r in got} == {("kept", 1, 2, 3, 4)}
    assert line_dedup.dedup_passages(no_docs, width).count() == 0


def test_pipeline_removes_chunks_by_bytes_and_the_passages_they_miss(spark, monkeypatch):
    """Chunk boundaries decide first; a passage that they cut through goes too, and nothing that is not a repeat."""
    from loanscope.llm import line_dedup, pipeline

    rng = random.Random(3)
    shared = [f"shared line {i} {rng.random()}" for i in range(12)]
    texts = ["\n".join([f"own {d} {i} {rng.random()}" for i in range(4)] + shared[d % 3 :] + [f"end {d}"]) for d in range(6)] + ["a\nb", "", None]
    docs = spark.createDataFrame([(d, t, 0) for d, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    asked = []
    whole = line_dedup.removal
    monkeypatch.setattr(line_dedup, "removal", lambda *a: asked.append(whole(*a)) or asked[-1])
    out = {r.doc_id: r.text for r in pipeline.line_stage(spark, docs, "").collect()}
    assert asked and asked[0].count() > 0
    chunks = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    runs = {r.doc_id: r.text for r in line_dedup.dedup_passages(docs).collect()}
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        gone = [x for x in lines if x not in (chunks[d] or "").split("\n") or x not in (runs[d] or "").split("\n")]
        assert out[d] == (text and "\n".join(x for x in lines if x not in gone))
    assert out[5].split("\n") == texts[5].split("\n")[:4] + ["end 5"]
