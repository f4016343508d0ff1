"""Line deduplication: repeated passages of lines, or whole content-defined chunks of lines.

``dedup_passages`` compares every run of ``MIN_LINES`` consecutive lines, so it finds each repeated passage of that many lines or
more, wherever it begins and ends: a passage is removed where all its runs have occurred before. Runs are decided by 128 bits of
SHA-256. The first occurrence of a run (smallest doc_id, then position) stays, as does a run that overlaps its own first
occurrence, and the first occurrence of every line. Runs are counted map-side; no pairs are formed.

``dedup_lines`` compares whole chunks only, which is less: a passage goes only where chunk boundaries fall inside it.

A rolling hash over the hashes of the last ``WINDOW_LINES`` lines ends a chunk wherever it is 0 modulo ``DIVISOR``; boundaries depend on
nearby lines only, so an inserted line shifts no other chunk. Chunks of ``MIN_LINES`` lines or more that occur again anywhere are compared byte
for byte with the first occurrence (smallest doc_id, then position) and removed where equal. The first occurrence stays.

Only hashes and positions of chunks are grouped; of texts, the chunks whose hash repeats are sent. The comparison joins each of
them with the one first occurrence of its hash, so a chunk that a third of all documents share is a skewed join side that
adaptive execution splits, never a group in one task.

Defined results: null and empty texts have no chunk and stay as they are; documents with a null id neither lose lines nor count as an
occurrence; rows with the same id are one document, their first chunks stay in each; a document all of whose lines are
removed has an empty text; lines end at ``\\n`` alone; other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import common
from loanscope.session import staged

WINDOW_LINES = 2
DIVISOR = 3
MIN_LINES = 2

MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15


def chunk_lines(lines: list[str], window: int = WINDOW_LINES, divisor: int = DIVISOR) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of each chunk."""
    h = [xxhash.xxh64_intdigest(line) for line in lines]
    drop = pow(FACTOR, window, 1 << 64)
    chunks, begin, rolling, whole = [], 0, 0, 0
    for i, value in enumerate(h):
        rolling = (rolling * FACTOR + value - (h[i - window] * drop if i >= window else 0)) & MASK
        whole = (whole * FACTOR + (value | 1)) & MASK
        mixed = (rolling ^ (rolling >> 29)) * 0xBF58476D1CE4E5B9 & MASK
        if i + 1 == len(h) or (i + 1 >= window and (mixed >> 32) % divisor == 0):
            chunks.append((begin, i + 1, xxhash.xxh64_intdigest(whole.to_bytes(8, "little"), i + 1 - begin)))
            begin, whole = i + 1, 0
    return chunks


def multi_line_chunks(text: str, min_lines: int = MIN_LINES) -> list[tuple[int, int, int, str]]:
    """(number, hash, lines, chunk text) of the chunks that can be removed."""
    lines = text.split("\n")
    out = []
    for n, (a, b, h) in enumerate(chunk_lines(lines)):
        if b - a >= min_lines and any(x.strip() for x in lines[a:b]):
            out.append((n, h - (1 << 64) if h >> 63 else h, b - a, "\n".join(lines[a:b])))
    return out


def removal(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text_hash, chunks: numbers of the chunks to remove."""
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").contains("\n")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            rows = [(d, n, h) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                    for n, h, _, _ in multi_line_chunks(t, min_lines)]
            yield pa.record_batch({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("doc_id", "n", "hash"))})

    chunks = staged(texts.mapInArrow(positions, "doc_id long, n long, hash long"), "line-chunks")
    first = (chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "n")).alias("first"))
             .filter("copies > 1").select("hash", "first"))
    marked = chunks.join(first, "hash").select("doc_id", "n", "hash", (F.struct("doc_id", "n") == F.col("first")).alias("is_first"))
    wanted = marked.groupBy("doc_id").agg(F.collect_list("n").alias("wanted"), F.collect_list("is_first").alias("firsts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            rows = []
            for d, x, t, want, firsts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "wanted", "firsts"))):
                is_first = dict(zip(want, firsts))
                rows += [(d, n, h, is_first[n], piece, x) for n, h, _, piece in multi_line_chunks(t, min_lines) if n in is_first]
            yield pa.record_batch({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()),
                "hash": pa.array([r[2] for r in rows], pa.int64()), "is_first": pa.array([r[3] for r in rows], pa.bool_()),
                "piece": pa.array([r[4] for r in rows], pa.string()), "text_hash": pa.array([r[5] for r in rows], pa.int64())})

    pieces = staged(texts.join(wanted.hint("merge"), "doc_id").withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        cut, "doc_id long, n long, hash long, is_first boolean, piece string, text_hash long"), "line-pieces")
    originals = pieces.filter("is_first").dropDuplicates(["hash"]).select("hash", F.col("piece").alias("original"))
    equal = pieces.filter("NOT is_first").join(originals, "hash").filter("piece = original")
    return equal.groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("chunks"))


def without_chunks(text: str, chunks: list[int]) -> tuple[str, int]:
    lines = text.split("\n")
    gone = set(chunks)
    kept = [x for n, (a, b, _) in enumerate(chunk_lines(lines)) if n not in gone for x in lines[a:b]]
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with repeated chunks removed from the text, and n_lines, n_removed_lines."""
    return without_rows(docs, staged(removal(docs, min_lines), "line-removal"), "chunks", without_chunks)


def without_rows(docs: DataFrame, gone: DataFrame, what: str, cut) -> DataFrame:
    """``docs`` without what ``cut`` takes out of a text by the column ``what`` of ``gone`` (doc_id, text_hash, ``what``)."""
    columns = [c for c in docs.columns if c != "n_removed_lines"]
    # how much is removed grows with the corpus, so it is never a broadcast: one plan at every size
    row, text, name = (common.fresh(c, columns) for c in ("gone_id", "gone_text", "gone"))
    joined = docs.select(columns).join(
        gone.select(F.col("doc_id").alias(row), F.col("text_hash").alias(text), F.col(what).alias(name)).hint("merge"),
        (F.col("doc_id").cast("long") == F.col(row)) & (F.xxhash64("text") == F.col(text)), "left").drop(row, text)
    return without(joined, columns, name, cut)


def without(joined: DataFrame, columns: list[str], gone: str, cut) -> DataFrame:
    """``joined`` without its column ``gone``, which ``cut`` has taken out of the text."""
    fields = [f for f in joined.schema.fields if f.name != gone]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_removed_lines long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(iter([batch])):
                texts, removed = [], []
                for text, chunks in zip(part.column("text").to_pylist(), part.column(gone).to_pylist()):
                    text, n = cut(text, chunks) if chunks and text is not None else (text, 0)
                    texts.append(text)
                    removed.append(n)
                arrays = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in columns]
                yield pa.record_batch(arrays + [pa.array(removed, pa.int64())], [*columns, "n_removed_lines"])

    return joined.mapInArrow(run, schema)


def line_runs(text: str, width: int = MIN_LINES) -> list[tuple[int, int, int]]:
    """(first line, two halves of the hash) of every run of ``width`` lines that are not all blank."""
    lines = text.split("\n")
    filled = [bool(x.strip()) for x in lines]
    digest = hashlib.sha256
    return [(i, *struct.unpack("<qq", digest("\n".join(lines[i : i + width]).encode()).digest()[:16]))
            for i in range(len(lines) - width + 1) if any(filled[i : i + width])]


def without_runs(text: str, starts: list[int], width: int = MIN_LINES) -> tuple[str, int]:
    lines = text.split("\n")
    gone = {i + k for i in starts for k in range(width)}
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def repeated_runs(docs: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """doc_id, text_hash, runs: first lines of the runs to remove."""
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").contains("\n")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    names = ("doc_id", "text_hash", "n", "h1", "h2")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            rows = [(d, x, *run) for d, x, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")))
                    for run in line_runs(t, width)]
            yield pa.record_batch({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)})

    runs = staged(texts.mapInArrow(positions, ", ".join(f"{n} long" for n in names)), "line-runs")
    first = (runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "n")).alias("first"))
             .filter("copies > 1").select("h1", "h2", "first"))
    later = runs.join(first.hint("merge"), ["h1", "h2"]).filter(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("n") >= F.col("first.n") + width))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("runs"))


def dedup_passages(docs: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with repeated passages of ``width`` lines or more removed from the text, and n_removed_lines."""
    return without_rows(docs, staged(repeated_runs(docs, width), "line-removal"), "runs", lambda text, starts: without_runs(text, starts, width))


def dedup_repeats(docs: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` without repeated content-defined chunks, compared byte for byte, nor the repeated passages of ``width`` lines
    or more that chunk boundaries cut through, and n_removed_lines. Both are found on the input and go at once."""
    found = removal(docs, width).join(repeated_runs(docs, width).hint("merge"), ["doc_id", "text_hash"], "full")
    gone = staged(found.select("doc_id", "text_hash", F.struct("chunks", "runs").alias("gone")), "line-removal")
    return without_rows(docs, gone, "gone", lambda text, gone: without_both(text, gone["chunks"] or [], gone["runs"] or [], width))


def without_both(text: str, chunks: list[int], starts: list[int], width: int = MIN_LINES) -> tuple[str, int]:
    lines = text.split("\n")
    gone = {i + k for i in starts for k in range(width)}
    if chunks:
        bounds = chunk_lines(lines)
        gone.update(i for n in chunks for i in range(*bounds[n][:2]))
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(kept), len(lines) - len(kept)
