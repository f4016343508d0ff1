"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids end together in the corpus.

Both tokenizers cut the bytes of a space and the text into runs. Every token points to its farthest-right overlapping token of the
other side; a token of the first side that ends where one of the other side ends points to itself, and its partner points to it. The
pointers are doubled (each token takes the pointer of its target) until nothing changes, for all texts of a slice at once: then every
token holds the terminal token of its group, the smallest run of bytes in which both sides begin and end together. The number of
doublings is the logarithm of the longest chain.

Where neither side has a token that goes on after a space, both sides begin and end together at every single space, so a text is the
words between its spaces one after the other: each distinct word is encoded and aligned once while it is kept, and a text takes the ids,
groups and links of its words. Texts with further spaces, and texts with a word that begins or ends in other white space, holds a character in doubt or is not spelled by its tokens, are
encoded and aligned as a whole.

``align`` needs no shuffle and returns ids and group sizes of each text, ``align_links`` only its links, packed. ``link_counts`` adds
up, over the whole corpus, how often each pair of ids ends together (tasks add first, so a pair that a third of all links share is one row of a task), and marks the pairs that are the
most frequent ones of their second id. ``link_scores`` carries the counts back to the texts: pairs with at least ``PAIR_SHARE`` of all
links (at most ``1 / PAIR_SHARE``, a proven bound) are held by every task, all others are joined; none of those is frequent, so the join
has no hot key.

Defined results: a null or empty text, and one whose tokens of either side do not spell a space and the text, has no tokens; white
space, repeated rows and rows with null ids are aligned like any other; further columns of the input are not read; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import byte_bpe, common
from loanscope.session import staged

PAIR_SHARE = 4e-6
SLICE_BYTES = 1 << 19
SPACE = "▁"  # stands for a space in pieces
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


class TokenBytes:
    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[common.ranges(self.start[ids], self.size[ids])]


@dataclass(eq=False)
class Tokenizers:
    """What tasks get of both tokenizers: contents of the files, tables made from them once."""

    first: str
    second: bytes
    first_bytes: TokenBytes
    second_bytes: TokenBytes
    ranks: byte_bpe.Ranks | None  # where the first file says what ``byte_bpe`` does
    doubtful: frozenset[str]  # characters on which the engines' Unicode tables differ
    words_apart: bool  # no piece of the second model goes on after a space


def read_tokenizers(first: str, second: str) -> Tokenizers:
    """Read a ``tokenizers`` file and a ``sentencepiece`` model on the driver; the size of both is fixed."""
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        first, second = a.read(), b.read()
    library, pieces = library_of(first), pieces_of(second)
    as_byte = byte_of_characters()
    entries = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    spelled = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    return Tokenizers(
        first, second, TokenBytes([bytes(as_byte[c] for c in e) if all(c in as_byte for c in e) else e.encode() for e in entries]),
        TokenBytes(spelled), plain_ranks(json.loads(first), as_byte), frozenset(byte_bpe.unassigned_words()),
        not any(SPACE in p.lstrip(SPACE) for p in names))


def library_of(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = True
    return tokenizer


def pieces_of(content: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=content)


def plain_ranks(spec: dict, as_byte: dict[str, int]) -> byte_bpe.Ranks | None:
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    usual = (model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space") and spec.get("normalizer") is None and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not usual:
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = model["vocab"]
    rank = [vocabulary[a + b] for a, b in merges]
    if rank != sorted(set(rank)):  # the order of the merges must be that of the ids
        return None
    pairs = {vocabulary[a] << 32 | vocabulary[b]: r for (a, b), r in zip(merges, rank)}
    single = {bytes([b]): vocabulary[c] for c, b in as_byte.items()}
    return byte_bpe.with_pairs(single, pairs, byte_bpe.BYTE_LEVEL_PATTERN)


class ByteLevel:
    """The first side: distinct pieces are merged by ``byte_bpe``; texts with characters in doubt, and all texts of files that
    ask for something else, go to the library."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.library = tokenizers, None
        self.encoder = byte_bpe.Encoder(tokenizers.ranks) if tokenizers.ranks else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, the offset of each text, and which texts they are known to spell."""
        doubtful = self.tokenizers.doubtful
        plain = np.array([self.encoder is not None and (t.isascii() or doubtful.isdisjoint(t)) for t in texts], bool)
        ids, edges = self.encoder.encode([" " + t if t and p else "" for t, p in zip(texts, plain)]) if plain.any() else flat([[]] * len(texts))
        if plain.all():
            return ids, edges, plain
        self.library = self.library or library_of(self.tokenizers.first)
        found = iter(self.library.encode_batch_fast([" " + t if t else "" for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return *flat([ids[x:y] if p else next(found).ids
                      for x, y, p, t in zip(edges[:-1], edges[1:], plain, texts)]), plain


    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clean words (see ``Aligner.clean``), which the caller keeps: a piece that begins with a space is the first of its word."""
        pieces = self.encoder.split(" " + " ".join(words)) if words else []
        ids, count = byte_bpe.encode_pieces(self.encoder.ranks, [p.encode() for p in pieces])
        begin = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        return ids, np.concatenate([[0], np.cumsum(count)])[np.append(begin, len(pieces))], np.ones(len(words), bool)


class Pieces:
    """The second side. Where no piece goes on after a space, words between single spaces are encoded once while they are kept; the
    model puts the space in front itself. Texts with further spaces go to the model as they are."""

    def __init__(self, tokenizers: Tokenizers):
        self.model, self.bytes, self.words_apart = pieces_of(tokenizers.second), tokenizers.second_bytes, tokenizers.words_apart
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count, self.same, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that the caller keeps; none of them is kept here."""
        return *flat(self.model.encode(words, num_threads=1)), np.zeros(len(words), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.number) > byte_bpe.KEPT_PIECES or self.held > byte_bpe.KEPT_BYTES:
            self.forget()
        plain = np.array([self.words_apart and "  " not in t and t[:1] != " " and t[-1:] != " " for t in texts], bool)
        found = [t.split(" ") if t and p else [] for t, p in zip(texts, plain)]
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(found)) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            ids, edges = flat(self.model.encode(new, num_threads=1))
            data, offsets = common.raw_text(pa.array([" " + w for w in new], pa.string()))
            self.held += len(data)
            self.same = np.concatenate([self.same, spelled(self.bytes, ids, edges, data, offsets)])
            self.start = np.concatenate([self.start, len(self.ids) + edges[:-1]])
            self.count = np.concatenate([self.count, np.diff(edges)])
            self.ids = np.concatenate([self.ids, ids])
        sizes = np.array([len(words) for words in found], np.int64)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(sizes.sum()))
        edges = np.concatenate([[0], np.cumsum(self.count[at])])[np.concatenate([[0], np.cumsum(sizes)])]
        ids = self.ids[common.ranges(self.start[at], self.count[at])]
        wrong = np.bincount(np.repeat(np.arange(len(texts)), sizes), ~self.same[at], len(texts)) > 0
        if plain.all():
            return ids, edges, ~wrong
        others = iter(self.model.encode([t for t, p in zip(texts, plain) if not p], num_threads=1))
        return *flat([ids[x:y] if p else next(others) for x, y, p in zip(edges[:-1], edges[1:], plain)]), plain & ~wrong


def byte_of_characters() -> dict[str, int]:
    """Printable characters of Latin-1 stand for their own byte; all other bytes, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def spelled(side: TokenBytes, ids: np.ndarray, edges: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the tokens spell: same bytes, same length."""
    ends = np.concatenate([[0], np.cumsum(side.size[ids])])[edges]
    length = np.diff(offsets)
    fits = np.diff(ends) == length
    whole = side.joined(ids)
    at = np.flatnonzero(fits)
    same = whole[common.ranges(ends[at], length[at])] == data[common.ranges(offsets[at], length[at])]
    wrong = np.bincount(np.repeat(at, length[at]), ~same, len(fits))
    return fits & (wrong == 0)


def kept_ids(ids: np.ndarray, edges: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.where(keep, np.diff(edges), 0)
    return ids[common.ranges(edges[:-1], size)], np.concatenate([[0], np.cumsum(size)])


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token on both sides, by pointer jumping, from their lengths; both sides cover the same bytes."""
    n, m = len(a_size), len(b_size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
    # the farthest-right overlapping token of the other side holds the last byte of this one
    a_to, b_to = np.repeat(np.arange(m), b_size)[a_ends - 1], np.repeat(np.arange(n), a_size)[b_ends - 1]
    target = np.concatenate([np.where(b_ends[a_to] > a_ends, n + a_to, np.arange(n)), b_to])
    while True:
        further = target[target]
        if (further == target).all():
            break
        target = further
    terminal = np.zeros(n, np.int64)  # terminal tokens are tokens of the first side
    terminal[target] = 1
    number = (np.cumsum(terminal) - 1)[target]
    return number[:n], number[n:]


@dataclass
class Slice:
    """Aligned texts of a slice, one after the other: ids and offsets of the texts on both sides, tokens per group, groups per text."""

    a: np.ndarray
    a_edges: np.ndarray
    b: np.ndarray
    b_edges: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    edges: np.ndarray

    def links(self) -> np.ndarray:
        """Pairs of ids that end together, first id << 32 | second id: the last tokens of each group."""
        return self.a[np.cumsum(self.a_sizes) - 1] << 32 | self.b[np.cumsum(self.b_sizes) - 1]

    def taken(self, at: np.ndarray) -> Slice:
        """Texts by their numbers, in that order."""
        (a, a_edges), (b, b_edges) = taken(self.a, self.a_edges, at), taken(self.b, self.b_edges, at)
        (a_sizes, edges), (b_sizes, _) = taken(self.a_sizes, self.edges, at), taken(self.b_sizes, self.edges, at)
        return Slice(a, a_edges, b, b_edges, a_sizes, b_sizes, edges)

    def joined(self, stops: np.ndarray) -> Slice:
        """Texts that run up to the given numbers made one text each."""
        return Slice(self.a, self.a_edges[stops], self.b, self.b_edges[stops], self.a_sizes, self.b_sizes, self.edges[stops])

    def followed(self, after: Slice) -> Slice:
        def edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([x, x[-1] + y[1:]])

        def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([x, y])

        return Slice(both(self.a, after.a), edges(self.a_edges, after.a_edges), both(self.b, after.b), edges(self.b_edges, after.b_edges),
                     both(self.a_sizes, after.a_sizes), both(self.b_sizes, after.b_sizes), edges(self.edges, after.edges))


def taken(values: np.ndarray, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = edges[at + 1] - edges[at]
    return values[common.ranges(edges[at], size)], np.concatenate([[0], np.cumsum(size)])


def no_texts() -> Slice:
    none, edge = np.zeros(0, np.int64), np.zeros(1, np.int64)
    return Slice(none, edge, none, edge, none, none, edge)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Links:
    """What a corpus is counted by, of each text: tokens on both sides, groups, their digest, packed links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    packed: list[bytes]


class Aligner:
    def __init__(self, tokenizers: Tokenizers):
        self.first, self.second = ByteLevel(tokenizers), Pieces(tokenizers)
        self.a_bytes, self.b_bytes, self.doubtful = tokenizers.first_bytes, tokenizers.second_bytes, tokenizers.doubtful
        self.words_apart = tokenizers.ranks is not None and tokenizers.words_apart
        self.forget()

    def forget(self) -> None:
        self.number, self.words, self.pairs, self.written, self.held = Numbers(), no_texts(), np.zeros(0, np.int64), [], 0
        self.apart = np.zeros(0, bool)  # words whose neighbours do not matter

    def clean(self, words: list[str]) -> np.ndarray:
        """Which words neither begin nor end in white space and hold no characters in doubt."""
        text = f" {' '.join(words)} "
        if not any(f" {c}" in text or f"{c} " in text for c in WHITE) and (text.isascii() or self.doubtful.isdisjoint(text)):
            return np.ones(len(words), bool)
        return np.array([not (w[0].isspace() or w[-1].isspace()) and (w.isascii() or self.doubtful.isdisjoint(w)) for w in words], bool)

    def learn(self, new: list[str]) -> None:
        clean = self.clean(new)
        some = self.whole(list(itertools.compress(new, clean)), self.first.encode_words, self.second.encode_words)
        some = some.joined(np.concatenate([[0], np.cumsum(clean)]))
        self.apart = np.concatenate([self.apart, np.diff(some.edges) > 0])
        text, edges = written(some)
        text, stops = text.tobytes(), edges.tolist()
        self.written += [text[x : y - 1] if y > x else b"" for x, y in zip(stops[:-1], stops[1:])]
        self.held += sum(map(len, new)) + len(text)
        self.pairs = np.concatenate([self.pairs, some.links()])
        self.words = self.words.followed(some)

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts are their words one after the other, the numbers of the words, and the place of the first word of each such text."""
        if len(self.number) > byte_bpe.KEPT_PIECES or self.held > byte_bpe.KEPT_BYTES:
            self.forget()
        known = len(self.number)
        found = [t.split(" ") if t and self.words_apart and "  " not in t and t[0] != " " and t[-1] != " " else [] for t in texts]
        sizes = np.array([len(words) for words in found], np.int64)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(sizes.sum()))
        if len(self.number) > known:
            self.learn(list(itertools.islice(self.number, known, None)))
        odd = np.bincount(np.repeat(np.arange(len(texts)), sizes), ~self.apart[at], len(texts)) > 0
        apart = (sizes > 0) & ~odd
        return apart, at if not odd.any() else at[np.repeat(apart, sizes)], np.concatenate([[0], np.cumsum(sizes[apart])])

    def align(self, texts: list[str]) -> Slice:
        apart, at, edges = self.placed(texts)
        by_words = self.words.taken(at).joined(edges)
        if apart.all():
            return by_words
        rest = self.whole([t for t, there in zip(texts, apart) if not there], self.first.encode, self.second.encode)
        return by_words.followed(rest).taken(np.argsort(np.argsort(~apart, kind="stable")))

    def links(self, texts: list[str]) -> Links:
        """The links of the texts, from those of their words: the tokens of a text are not put together."""
        apart, at, edges = self.placed(texts)
        counts = [np.zeros(len(texts), np.int64) for _ in range(3)]
        for count, of in zip(counts, (self.words.a_edges, self.words.b_edges, self.words.edges)):
            before = np.concatenate([[0], np.cumsum(np.diff(of)[at])])
            count[apart] = np.diff(before[edges])
        pairs, ends = taken(self.pairs, self.words.edges, at)
        groups = list(map(self.written.__getitem__, at.tolist()))
        told = [hashlib.sha256(b";".join(groups[x:y])).hexdigest() for x, y in zip(edges[:-1], edges[1:])]
        packed = packed_links(pairs, ends[edges])
        if not apart.all():
            rest = self.whole([t for t, there in zip(texts, apart) if not there], self.first.encode, self.second.encode)
            for count, of in zip(counts, (rest.a_edges, rest.b_edges, rest.edges)):
                count[~apart] = np.diff(of)
            more = iter(zip(digests(rest), packed_links(rest.links(), rest.edges)))
            both = iter(zip(told, packed))
            told, packed = map(list, zip(*(next(both) if there else next(more) for there in apart)))
        return Links(*counts, told, packed)

    def whole(self, texts: list[str], first: Callable, second: Callable) -> Slice:
        keep = np.array([bool(t) for t in texts], bool)
        sides = []
        for encode, table in ((first, self.a_bytes), (second, self.b_bytes)):
            ids, edges, known = encode(texts)
            asked = np.flatnonzero(~known & keep)
            if len(asked):
                data, offsets = common.raw_text(pa.array([" " + texts[i] for i in asked], pa.string()))
                some, some_edges = kept_ids(ids, edges, np.isin(np.arange(len(texts)), asked))
                keep[asked] = spelled(table, some, some_edges[np.concatenate([asked, [len(texts)]])], data, offsets)
            sides.append((ids.astype(np.int64), edges))
        (a, a_edges), (b, b_edges) = ((ids, edges) if keep.all() else kept_ids(ids, edges, keep) for ids, edges in sides)
        # no token of one text overlaps a token of another
        a_group, b_group = groups(self.a_bytes.size[a], self.b_bytes.size[b])
        text = np.repeat(np.arange(len(texts)), np.diff(a_edges))[starts_of(a_group)]
        edges = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        return Slice(a, a_edges, b, b_edges, np.bincount(a_group) if len(a) else a, np.bincount(b_group) if len(b) else b, edges)


@functools.lru_cache(1)
def aligner_of(tokenizers: Tokenizers) -> Aligner:
    """The aligner of this worker process: its next task goes on with the words that earlier ones have encoded, within the same bounds."""
    return Aligner(tokenizers)


def slices_of(docs: DataFrame, tokenizers: Tokenizers, text: str, key: str, columns, schema: str) -> DataFrame:
    """``key`` and what ``columns`` makes of each aligned slice."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(shared.value)
        for part in common.slices(batches, "text", SLICE_BYTES):
            yield pa.record_batch({"key": part.column("key")} | columns(aligner, [t or "" for t in part.column("text").to_pylist()]))

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def align(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, a_ids, b_ids, and a_sizes, b_sizes: how many tokens of each side the groups have, in their order."""
    def columns(aligner: Aligner, texts: list[str]) -> dict[str, pa.Array]:
        s = aligner.align(texts)
        return {"a_ids": listed(s.a, s.a_edges), "b_ids": listed(s.b, s.b_edges), "a_sizes": listed(s.a_sizes, s.edges), "b_sizes": listed(s.b_sizes, s.edges)}

    return slices_of(docs, tokenizers, text, key, columns, ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")))


def align_links(docs: DataFrame, tokenizers: Tokenizers, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_a, n_b, n_groups, groups_sha256, and ``links``: the linked ids of each text in their order, packed.

    The groups themselves are gone here: this is what counting over a corpus needs, in the fewest bytes.
    """
    def columns(aligner: Aligner, texts: list[str]) -> dict[str, pa.Array]:
        links = aligner.links(texts)
        return {c: pa.array(getattr(links, c)) for c in ("n_a", "n_b", "n_groups")} | {
            "groups_sha256": pa.array(links.digests, pa.string()), "links": pa.array(links.packed, pa.binary())}

    return slices_of(docs, tokenizers, text, key, columns, "n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def packed_links(links: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The ids of each text, the first ones before the second ones; two bytes each where all of them fit, else four, said by a byte in front."""
    first, second = links >> 32, links & 0xFFFFFFFF
    short = not len(links) or max(int(first.max()), int(second.max())) < 1 << 16
    first, second = (x.astype(np.uint16 if short else np.uint32) for x in (first, second))
    return [bytes([2 if short else 4]) + first[x:y].tobytes() + second[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]


def unpacked_links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all texts, and the offset of each text."""
    pairs = []
    for data in column.to_pylist():
        ids = np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, offset=1).astype(np.int64)
        pairs.append(ids[: len(ids) // 2] << 32 | ids[len(ids) // 2 :])
    return np.concatenate(pairs or [np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(p) for p in pairs], dtype=np.int64)])


def starts_of(group: np.ndarray) -> np.ndarray:
    """Places where a new group begins."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def listed(values: np.ndarray, edges) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def link_counts(linked: DataFrame) -> DataFrame:
    """pair, n, best: how many links of all texts hold a pair of ids, and whether no pair with the same second id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in batches:
            held.append(np.unique(unpacked_links(part.column("links"))[0], return_counts=True))
            if len(held) > 8:
                held = [common.summed(*map(np.concatenate, zip(*held)))]
        if held:
            pairs, n = common.summed(*map(np.concatenate, zip(*held)))
            for begin in range(0, len(pairs), 1 << 16):
                yield pa.record_batch({"pair": pa.array(pairs[begin : begin + (1 << 16)]), "n": pa.array(n[begin : begin + (1 << 16)])})

    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    pairs = linked.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("second", second)
    pairs = staged(pairs, "alignment-pairs")
    most = pairs.groupBy("second").agg(F.max("n").alias("most"))
    return staged(pairs.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-counts")


def link_scores(linked: DataFrame, counts: DataFrame, key: str = "doc_id", share: float = PAIR_SHARE) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``linked`` (``align_links``, stored)."""
    spark = linked.sparkSession
    links = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") >= share * links).select("pair", "n", "best").toArrow()
    pairs = often.column("pair").to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast(
        (pairs[order], often.column("n").to_numpy()[order], often.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]))
    sums = ("n_links", "n_best", "count_sum")
    told = ("n_a", "n_b", "n_groups", "groups_sha256")
    kinds = {f.name: f.dataType.simpleString() for f in linked.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, best = shared.value
        context = TaskContext.get()
        turn = (context.partitionId() if context else 0) << 40
        for part in batches:
            rows = part.num_rows
            row = turn + np.arange(rows)
            turn += rows
            pair, edges = unpacked_links(part.column("links"))
            text = np.repeat(np.arange(rows), np.diff(edges))
            at = np.minimum(np.searchsorted(table, pair), max(len(table) - 1, 0))
            there = table[at] == pair if len(table) else np.zeros(len(pair), bool)
            totals = [np.diff(edges)] + [sum_by(text[there], value[at[there]].astype(np.int64), rows) for value in (best, n)]
            yield pa.record_batch({"row": pa.array(row), "key": part.column("key")} | {c: part.column(c) for c in told} | dict(
                zip(sums, map(pa.array, totals))) | {"pair": pa.nulls(rows, pa.int64())})
            rare = np.flatnonzero(~there)
            if len(rare):
                none = {c: pa.nulls(len(rare), part.column(c).type) for c in ("key", *told)} | dict.fromkeys(sums, pa.nulls(len(rare), pa.int64()))
                yield pa.record_batch({"row": pa.array(row[text[rare]])} | none | {"pair": pa.array(pair[rare])})

    schema = f"row long, key {kinds[key]}, n_a long, n_b long, n_groups long, groups_sha256 string, " + ", ".join(f"{c} long" for c in sums) + ", pair long"
    scored = staged(linked.select(F.col(key).alias("key"), *told, "links").mapInArrow(score, schema), "alignment-scores")
    rest = (scored.filter("pair IS NOT NULL").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
            .join(counts.filter(F.col("n") < share * links), "pair")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")))
    return scored.filter("pair IS NULL").join(rest, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")


def sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by ascending place."""
    before = np.concatenate([[0], np.cumsum(values)])
    return before[np.searchsorted(at, np.arange(n), "right")] - before[np.searchsorted(at, np.arange(n), "left")]


def digests(s: Slice) -> list[str]:
    """SHA-256 of the groups of each text as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    text, edge = written(s)
    return ["" if x == y else hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(edge[:-1], edge[1:])]


def written(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts in characters, each group with a ``;`` after it, and the offset of each text."""
    digits, length = decimals(1 << max(17, int(max(s.a.max(initial=0), s.b.max(initial=0))).bit_length()))
    both = s.a_sizes + s.b_sizes
    at = np.cumsum(both) - both
    ids = np.empty(int(both.sum()), np.int64)
    ids[common.ranges(at, s.a_sizes)] = s.a
    ids[common.ranges(at + s.a_sizes, s.b_sizes)] = s.b
    after = np.full(len(ids), ord(","), np.uint8)
    after[at + s.a_sizes - 1] = ord("|")
    after[at + both - 1] = ord(";")
    size = length[ids] + 1
    stop = np.cumsum(size)
    whole = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    whole[common.ranges(stop - size, size - 1)] = digits[common.ranges(ids * digits_width(), size - 1)]
    whole[stop - 1] = after
    tokens = np.concatenate([[0], np.cumsum(both)])[s.edges]
    return whole, np.concatenate([[0], stop])[tokens]


def digits_width() -> int:
    return 8


@functools.lru_cache(1)
def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids below ``size``, each in a field of its own, and their number."""
    rows = [str(i).encode() for i in range(size)]
    fields = np.frombuffer(b"".join(r.ljust(digits_width()) for r in rows), np.uint8)
    return fields, np.array([len(r) for r in rows], np.int64)
