"""Substring deduplication with difference-cover anchors.

Wanted: every window of ``window`` consecutive words whose word sequence also starts anywhere else. Hashing all windows of a corpus
would send one row per word. Instead, short runs are hashed only at anchor positions: positions whose number modulo
``PERIOD`` lies in a difference cover. For any two positions there is a shift below the period that brings both onto the cover, so
two equal windows always share an anchor at the same offset inside both. Only windows around anchors whose hash occurs again are
candidates; they are extended to the whole window, and the windows' own hashes (96 bits) decide.

Both rounds count hashes in buckets: tasks send packed arrays by hash bucket, and a hash that occurs several times in one slice of
a task is resolved there and sent once, so a passage that a third of all documents share loads no bucket. What comes back
to a document are its own positions. No pair of documents is ever formed.

Defined results: a null text has no words, and the hash of the empty text; repeated rows are copies of each other; rows with
a null id are treated like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import common
from loanscope.session import staged

WINDOW = 35
# A perfect difference set: every non-zero difference modulo 21 occurs exactly once (fixed values).
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

ASK = "bucket int, keys binary, hashes binary, more binary, at binary, pos binary"


def anchor_width(window: int) -> int:
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"a window must have {PERIOD} words at least")
    return width


def anchors(n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and position in it of every anchor that has ``width`` words after it."""
    last = np.maximum(n_words - width + 1, 0)
    text = np.repeat(np.arange(len(n_words)), last)
    pos = common.ranges(np.zeros(len(n_words), np.int64), last)
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    keep = on[pos % PERIOD]
    return text[keep], pos[keep]


def candidate_windows(n_words: int, found: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor of ``found`` at an offset below the period."""
    change = np.zeros(n_words + 2, np.int64)
    np.add.at(change, np.maximum(found - PERIOD + 1, 0), 1)
    np.add.at(change, found + 1, -1)
    inside = np.cumsum(change[:n_words]) > 0
    return np.flatnonzero(inside[: max(n_words - window + 1, 0)])


def ask_rows(keys: np.ndarray, text: np.ndarray, pos: np.ndarray, h: np.ndarray, more: np.ndarray | None, parts: int, turn: int) -> pa.RecordBatch:
    """Pack the hashes of one slice by bucket. ``keys``: row key of each text. Hashes that repeat inside the slice are sent
    once; all their positions are known to repeat and go, without hash, to the bucket whose turn it is."""
    order = np.lexsort((pos, text, h)) if more is None else np.lexsort((pos, text, more, h))
    h, text, pos = h[order], text[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        more = more[order]
        new[1:] |= more[1:] != more[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(h)]]))
    known = np.repeat(size > 1, size)
    rows = []
    dealt, edges = common.deal(h[begin], parts)
    for b in np.flatnonzero(np.diff(edges)):
        take = np.sort(begin[dealt[edges[b] : edges[b + 1]]])
        take = take[np.lexsort((pos[take], text[take]))]
        rows.append((int(b), *pack_refs(keys, text[take], pos[take]), h[take].tobytes(), None if more is None else more[take].tobytes()))
    if known.any():
        take = np.flatnonzero(known)
        take = take[np.lexsort((pos[take], text[take]))]
        rows.append((turn % parts, *pack_refs(keys, text[take], pos[take]), None, None))
    columns = list(zip(*rows)) or [[]] * 6
    return pa.record_batch({
        "bucket": pa.array(columns[0], pa.int32()), "keys": pa.array(columns[1], pa.binary()), "hashes": pa.array(columns[4], pa.binary()),
        "more": pa.array(columns[5], pa.binary()), "at": pa.array(columns[2], pa.binary()), "pos": pa.array(columns[3], pa.binary())})


def pack_refs(keys: np.ndarray, text: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Distinct row keys, how many entries each has, and the positions."""
    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    counts = np.diff(np.concatenate([edges, [len(text)]]))
    return keys[text[edges]].tobytes(), counts.astype(np.int32).tobytes(), pos.astype(np.int32).tobytes()


def answer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Positions whose hash occurs again, packed by bucket of their row key."""
    held: list[tuple] = []
    for batch in batches:
        for keys, hashes, more, at, pos in zip(*(batch.column(c).to_pylist() for c in ("keys", "hashes", "more", "at", "pos"))):
            keys, at, pos = np.frombuffer(keys, np.int64), np.frombuffer(at, np.int32), np.frombuffer(pos, np.int32)
            if hashes is None:
                yield dealt_back(np.repeat(keys, at), pos, parts)
            else:
                held.append((np.repeat(keys, at), pos, np.frombuffer(hashes, np.uint64), None if more is None else np.frombuffer(more, np.uint32)))
    if not held:
        return
    key, pos, h = (np.concatenate([x[i] for x in held]) for i in range(3))
    more = None if held[0][3] is None else np.concatenate([x[3] for x in held])
    held.clear()
    order = np.argsort(h) if more is None else np.lexsort((more, h))
    same = h[order][1:] == h[order][:-1]
    if more is not None:
        same &= more[order][1:] == more[order][:-1]
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = order[again]
    if len(hit):
        yield dealt_back(key[hit], pos[hit], parts)


def dealt_back(key: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    dealt, edges = common.deal(key.view(np.uint64), parts)
    key, pos = key[dealt], pos[dealt].astype(np.int32)
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        k = key[edges[b] : edges[b + 1]]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        counts = np.diff(np.concatenate([first, [len(k)]])).astype(np.int32)
        rows.append((b, k[first].tobytes(), counts.tobytes(), pos[edges[b] : edges[b + 1]].tobytes()))
    columns = list(zip(*rows))
    return pa.record_batch({"bucket": pa.array(columns[0], pa.int32())} | {
        c: pa.array(columns[i], pa.binary()) for i, c in enumerate(("keys", "at", "pos"), 1)})


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row key: all its positions, sorted; as many as the row has words at most."""
    held = []
    for batch in batches:
        for keys, at, pos in zip(*(batch.column(c).to_pylist() for c in ("keys", "at", "pos"))):
            held.append((np.repeat(np.frombuffer(keys, np.int64), np.frombuffer(at, np.int32)), np.frombuffer(pos, np.int32)))
    if not held:
        return
    key, pos = (np.concatenate([x[i] for x in held]) for i in range(2))
    held.clear()
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
    key, pos = key[new], pos[new]
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
    for k in range(0, len(edges) - 1, 4096):
        span = edges[k : k + 4097].tolist()
        yield pa.record_batch({"key": pa.array(key[span[:-1]]),
                               "found": pa.array([pos[s:e].tobytes() for s, e in zip(span[:-1], span[1:])], pa.binary())})


def asked_again(asked: DataFrame, name: str) -> DataFrame:
    """key, found: the positions of each row whose hash occurs again. Only packed arrays are shuffled, by hash and then by row."""
    parts = common.shuffle_parts(asked.sparkSession)
    back = asked.repartitionById(parts, F.col("bucket")).mapInArrow(
        lambda batches: answer(batches, parts), "bucket int, keys binary, at binary, pos binary")
    found = staged(back.repartitionById(parts, F.col("bucket")).mapInArrow(gather, "key long, found binary"), name)
    common.release(asked.sparkSession)  # the packed hashes are no longer needed
    return found


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
                       F.xxhash64("doc_id", F.lit(7), text).alias("key"))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, found: packed starts of the windows of each row that occur again; rows without such windows are left out."""
    parts = common.shuffle_parts(docs.sparkSession)
    width = anchor_width(window)

    def turn() -> int:
        context = TaskContext.get()
        return context.partitionId() if context else 0

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in enumerate(common.slices(batches)):
            data, offsets = common.raw_text(part.column("text"))
            starts, ends, first = common.word_bounds(data, offsets)
            text, pos = anchors(np.diff(first), width)
            if len(text):
                h = common.window_hashes(common.word_hashes(data, starts, ends), first[text] + pos, width)
                yield ask_rows(part.column("key").to_numpy(), text, pos, h, None, parts, turn() + n)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in enumerate(common.slices(batches)):
            data, offsets = common.raw_text(part.column("text"))
            starts, ends, first = common.word_bounds(data, offsets)
            counts = np.diff(first)
            windows = [candidate_windows(int(c), positions(f), window) for c, f in zip(counts, part.column("found"))]
            text = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            if not len(text):
                continue
            pos = np.concatenate(windows)
            words = common.word_hashes(data, starts, ends)
            h = common.window_hashes(words, first[text] + pos, window)
            more = (common.window_hashes(words, first[text] + pos, window, 0xA24BAED4963EE407) >> np.uint64(32)).astype(np.uint32)
            yield ask_rows(part.column("key").to_numpy(), text, pos, h, more, parts, turn() + n)

    texts = keyed(docs).select("key", "text")
    near = asked_again(texts.mapInArrow(ask_anchors, ASK), "repeated-anchors")
    return asked_again(texts.join(near, "key").select("key", "text", "found").mapInArrow(ask_windows, ASK), "repeated-windows")


def positions(found) -> np.ndarray:
    return np.frombuffer(found.as_py() or b"", np.int32).astype(np.int64)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``."""
    marks = repeated(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            data, offsets = common.raw_text(part.column("text"))
            starts, ends, first = common.word_bounds(data, offsets)
            counts = np.diff(first)
            covered = np.zeros(len(starts), bool)
            for i, f in enumerate(part.column("found")):
                if f.is_valid:
                    at = positions(f)
                    change = np.zeros(int(counts[i]) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    covered[first[i] : first[i + 1]] = np.cumsum(change[:-1]) > 0
            raw = data.tobytes()
            kept = [b" ".join([raw[s:e] for s, e in zip(starts[lo:hi][~covered[lo:hi]].tolist(), ends[lo:hi][~covered[lo:hi]].tolist())])
                    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
            gone = np.concatenate([[0], np.cumsum(covered)])
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)),
                "n_removed": pa.array((gone[first[1:]] - gone[first[:-1]]).astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "kept_text": pa.array([k.decode() for k in kept], pa.string())})

    return keyed(docs).join(marks, "key", "left").select("doc_id", "text", "found").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
