"""Byte-level byte-pair encoding by a file of ranks, and decoding.

Every match of the split pattern is a piece; a piece that is a token itself becomes that token, all others are merged from
single bytes. Distinct pieces of a slice of texts are put into padded numpy matrices by length (widths 2, 4, 8, ...). In each
round every row merges its leftmost pair of minimum rank: a pair is looked up in a hash table over (left id, right id), the row is
compacted by one place and only the two pairs beside the merge are looked up again. Rows without a pair left leave the matrix,
and columns that no row needs any more are cut off. A pair may merge if its joined bytes are a token, whatever merges the
token was made by, so the table holds every split of every token into two tokens.

Pieces above ``MATRIX_BYTES`` bytes are rows of their own. There one round merges every occurrence of the minimum pair, where no pair
that arises on the way has a smaller rank (so one merge at a time would do the same), and only the leftmost one where it has.

Tasks keep the pieces that they have met in a table that starts anew above ``KEPT_PIECES`` pieces or ``KEPT_BYTES`` bytes, so memory
is bounded; nothing is shuffled. Ranks travel as one broadcast, bounded by the vocabulary.

Defined results: a null text is empty and has no tokens; white space, unassigned characters and repeated rows are encoded like
any other text; other columns are kept, one named like the new column is replaced; an empty table gives an empty result. Decoding
a null list gives null; a null id or one outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import common

MATRIX_BYTES = 512
MATRIX_CELLS = 1 << 21
KEPT_PIECES = 1 << 17
KEPT_BYTES = 8 << 20

# The split pattern of byte-level tokenizers (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_PAIR = np.iinfo(np.int32).max
OTHER = "͸"  # a character that is no letter, number or white space


@dataclass
class Ranks:
    """A vocabulary and the hash table of its pairs."""

    tokens: dict[bytes, int]
    data: np.ndarray  # bytes of all tokens, by id
    offsets: np.ndarray
    byte_ids: np.ndarray
    slots: np.ndarray  # left << 32 | right, or all ones where empty
    values: np.ndarray
    pattern: str
    unknown: str  # characters that the pattern's engine calls letters or numbers and tiktoken's does not

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined pair, NO_PAIR where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        mask = np.uint64(len(self.slots) - 1)
        at = common.mix(key.copy()) & mask
        out = np.full(len(key), NO_PAIR, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.slots[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != EMPTY)]
            at[open_] = (at[open_] + np.uint64(1)) & mask
        return out


EMPTY = np.uint64(2**64 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def build(ranks: dict[bytes, int], pattern: str) -> Ranks:
    """Tables of a vocabulary that holds all single bytes."""
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    known = sorted(ranks.items(), key=lambda x: x[1])
    size = np.zeros(known[-1][1] + 1, np.int64)
    size[[i for _, i in known]] = [len(t) for t, _ in known]
    pairs = {}
    for token, rank in known:
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return Ranks(ranks, np.frombuffer(b"".join(t for t, _ in known), np.uint8), np.concatenate([[0], np.cumsum(size)]),
                 byte_ids, *hashed(pairs), pattern, unknown_characters())


def with_pairs(single: dict[bytes, int], pairs: dict[int, int], pattern: str) -> Ranks:
    """A vocabulary given by its merges (left << 32 | right to the joined id), for encoding alone: no piece is a token as a whole."""
    byte_ids = np.array([single[bytes([b])] for b in range(256)], np.int32)
    return Ranks({}, np.zeros(0, np.uint8), np.zeros(1, np.int64), byte_ids, *hashed(pairs), pattern, "")


def hashed(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash table with open places; a quarter of it or less is full."""
    keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
    values = np.fromiter(pairs.values(), np.int32, len(pairs))
    capacity = 1 << max(4 * len(keys), 16).bit_length()
    slots, held = np.full(capacity, EMPTY), np.zeros(capacity, np.int32)
    at, open_ = common.mix(keys.copy()) & np.uint64(capacity - 1), np.arange(len(keys))
    while len(open_):
        free = open_[slots[at[open_]] == EMPTY]
        slots[at[free]] = keys[free]  # of several for one slot the last is written
        placed = slots[at[open_]] == keys[open_]
        held[at[open_[placed]]] = values[open_[placed]]
        open_ = open_[~placed]
        at[open_] = (at[open_] + np.uint64(1)) & np.uint64(capacity - 1)
    return slots, held


def unassigned_words() -> list[str]:
    """Letters and numbers to ``regex``, whose Unicode tables are the newest here, that Python's tables do not know."""
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    return regex.findall(r"[\p{L}\p{N}]", unassigned)


def unknown_characters() -> str:
    """Characters that are letters or numbers to ``regex`` and not to tiktoken, whose Unicode tables are older.

    tiktoken is asked about each: in a vocabulary that holds ``a`` and ``1`` followed by it, one token says that it belongs to them.
    """
    doubtful = unassigned_words()
    vocabulary = {bytes([b]): b for b in range(256)}
    for c in doubtful:
        for before in "a1":
            vocabulary.setdefault((before + c).encode(), len(vocabulary))
    asked = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=vocabulary, special_tokens={})
    return "".join(c for c in doubtful if all(len(asked.encode_ordinary(b + c)) > 1 for b in "a1"))


def splitter(ranks: Ranks):
    """Function from a text to its pieces."""
    find = regex.compile(ranks.pattern).finditer
    find_all = regex.compile(ranks.pattern).findall
    if not ranks.unknown:
        return find_all
    doubtful = frozenset(ranks.unknown)
    as_other = dict.fromkeys(map(ord, ranks.unknown), OTHER)

    def pieces(text: str) -> list[str]:
        if text.isascii() or doubtful.isdisjoint(text):
            return find_all(text)
        return [text[m.start() : m.end()] for m in find(text.translate(as_other))]

    return pieces


def merge_matrix(ranks: Ranks, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows one after the other, and their number in each row; rows are padded after ``length`` ids."""
    n = len(ids)
    out, left = np.full(ids.shape, -1, np.int32), length.copy()
    rank = np.full((n, ids.shape[1]), NO_PAIR, np.int32)
    row, column = np.nonzero(np.arange(ids.shape[1])[None, 1:] < length[:, None])
    rank[row, column] = ranks.pair(ids[row, column], ids[row, column + 1])
    active = np.arange(n)
    ids = ids.copy()
    while len(active):
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(active)), at]
        going = best != NO_PAIR
        if not going.all():
            done = ~going
            out[active[done], : ids.shape[1]] = ids[done]
            active, ids, rank, at, best = active[going], ids[going], rank[going], at[going], best[going]
            if not len(active):
                break
        left[active] -= 1
        width = int(left[active].max())
        rows = np.arange(len(active))
        # the merged token takes the place of its left part, all after its right part move up
        source = np.arange(ids.shape[1])[None, :]
        source = np.minimum(source + (source > at[:, None]), ids.shape[1] - 1)
        last = np.arange(ids.shape[1])[None, :] >= left[active][:, None]
        ids[rows, at] = best
        ids = np.where(last, -1, np.take_along_axis(ids, source, 1))[:, : max(width, 1)]
        rank = np.where(last, NO_PAIR, np.take_along_axis(rank, source, 1))[:, : max(width, 1)]
        rank[rows, at] = NO_PAIR
        for place in (at - 1, at):
            inside = np.flatnonzero((place >= 0) & (place + 1 < left[active]))
            p = place[inside]
            rank[inside, p] = ranks.pair(ids[inside, p], ids[inside, p + 1])
    return out[np.arange(out.shape[1])[None, :] < left[:, None]], left


def merge_long(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """Token ids of one long piece."""
    rank = ranks.pair(ids[:-1], ids[1:])
    while len(rank) and (best := int(rank.min())) != NO_PAIR:
        where = np.flatnonzero(rank == best)
        # of occurrences that overlap, every other one from the left
        run = np.concatenate([[True], np.diff(where) > 1])
        begin = where[np.flatnonzero(run)][np.cumsum(run) - 1]
        chosen = where[(where - begin) % 2 == 0]
        merged = ids.copy()
        merged[chosen] = best
        keep = np.ones(len(ids), bool)
        keep[chosen + 1] = False
        before = merged[keep]
        place = np.cumsum(keep)[chosen] - 1
        with_left = place[place > 0]
        with_right = chosen[chosen + 2 < len(ids)]
        sooner = (ranks.pair(before[with_left - 1], before[with_left]) < best).any() or (
            ranks.pair(np.full(len(with_right), best), ids[with_right + 2]) < best).any()
        if sooner:
            first = int(chosen[0])
            ids = np.concatenate([ids[:first], [best], ids[first + 2 :]]).astype(np.int32)
        else:
            ids = before
        rank = ranks.pair(ids[:-1], ids[1:])
    return ids


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after the other, and their number in each piece."""
    count = np.ones(len(pieces), np.int64)
    whole = np.fromiter((ranks.tokens.get(p, -1) for p in pieces), np.int64, len(pieces))
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # piece numbers, ids in their order
    direct = np.flatnonzero(whole >= 0)
    parts.append((direct, whole[direct].astype(np.int32)))
    rest = np.flatnonzero(whole < 0)
    length = np.array([len(pieces[i]) for i in rest], np.int64)
    bucket = np.where(length > MATRIX_BYTES, -1, np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    for b in np.unique(bucket):
        of = rest[bucket == b]
        if b < 0:
            for i in of:
                ids = merge_long(ranks, ranks.byte_ids[np.frombuffer(pieces[i], np.uint8)])
                count[i] = len(ids)
                parts.append((np.array([i]), ids))
            continue
        width = 1 << int(b)
        step = max(MATRIX_CELLS // width, 1)
        for begin in range(0, len(of), step):
            some = of[begin : begin + step]
            size = np.array([len(pieces[i]) for i in some], np.int64)
            data = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
            ids = np.full((len(some), width), -1, np.int32)
            ids[np.arange(width)[None, :] < size[:, None]] = ranks.byte_ids[data]
            found, n = merge_matrix(ranks, ids, size)
            count[some] = n
            parts.append((some, found))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(offsets[-1]), np.int32)
    for of, ids in parts:
        out[common.ranges(offsets[of], count[of])] = ids
    return out, count


class Encoder:
    """Encodes slices of texts; distinct pieces are merged once while they are kept."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.split = ranks, splitter(ranks)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and the offset of each text."""
        if len(self.number) > KEPT_PIECES or self.bytes > KEPT_BYTES:
            self.forget()
        found = [self.split(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(found)) if p not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            coded = [p.encode() for p in new]
            self.bytes += sum(map(len, coded))
            ids, count = encode_pieces(self.ranks, coded)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
        sizes = [len(pieces) for pieces in found]
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        totals = np.concatenate([[0], np.cumsum(self.count[at])])
        return self.ids[common.ranges(self.start[at], self.count[at])], totals[edges]


def with_list(part: pa.RecordBatch, names: list[str], name: str, array: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*(part.column(c) for c in names), array], [*names, name])


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", out: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with an array column of the token ids of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in docs.columns if c != out and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in common.slices(batches, text):
            ids, offsets = encoder.encode(part.column(text).to_pylist())
            yield with_list(part, names, out, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))

    texts = docs.withColumn(text, F.col(text).cast("string")).select(*names, *([] if keep_text else [text]))
    return texts.mapInArrow(run, f"{fields}, `{out}` array<int>")


def decode(rows: DataFrame, ranks: Ranks, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a binary column of the bytes of their token ids."""
    shared = rows.sparkSession.sparkContext.broadcast((ranks.data, ranks.offsets))
    names = [c for c in rows.columns if c != out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, offsets = shared.value
        size = np.diff(offsets)
        for batch in batches:
            lists = batch.column(ids)
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a token id is null")
            flat = flat.to_numpy().astype(np.int64)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(size) and size[flat].all()):
                raise ValueError("a token id is not in the vocabulary")
            whole = data[common.ranges(offsets[flat], size[flat])]
            at = np.concatenate([[0], np.cumsum(size[flat])])[edges]
            texts = [whole[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist())]
            yield with_list(batch, names, out, pa.array(texts, pa.binary()))

    return rows.select(names).mapInArrow(run, f"{fields}, `{out}` binary")
