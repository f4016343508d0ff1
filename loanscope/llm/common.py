"""Helpers shared by the text operators: table access, words of Arrow text columns, hashes of word runs.

Texts stay in Arrow buffers. Words are runs of bytes other than 0x20 and 0x09-0x0D (those bytes never occur inside a
UTF-8 character), found for a whole batch at once. A run of words is hashed from prefix sums, so that every window costs
the same whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.session import configure, release  # noqa: F401

# Words are runs of anything but these bytes (fixed values).
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_bases: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` equals, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text; a longer text makes a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_text(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before = inside[:-1].copy()
    before[cut] = False
    starts = np.flatnonzero(inside[1:] & ~before)
    after = inside[1:].copy()
    after[cut] = False
    ends = np.flatnonzero(inside[:-1] & ~after)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _bases.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if size > 4 * SLICE_BYTES:  # a very long text: not kept
            return both[0][:n], both[1][:n]
        _bases[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair, from prefix sums."""
    power, inverse = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(_BYTE_VALUES[data], starts, ends, 0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    return run_hashes(words, starts, starts + width, base)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``start, start+1, ..., start+count-1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    steps[np.cumsum(counts)[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(steps)


def deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts hashes by bucket (hash modulo ``parts``), and the edges of the buckets in that order."""
    bucket = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=parts))])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edges], np.add.reduceat(counts, edges)


def crc_fold(doc_id, folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``keys`` (long or int), and the edges of the groups in each table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            edges = group_edges(whole, keys)
            if len(edges) > 2:  # the last group may go on
                yield whole.slice(0, int(edges[-2])), edges[:-1]
                held = whole.slice(int(edges[-2])).to_batches()
            else:
                held = whole.to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, group_edges(whole, keys)


def group_edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate([np.flatnonzero(new), [rows.num_rows]])
