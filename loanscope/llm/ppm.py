"""Language-model scores by prediction by partial matching, next to a smoothed word model.

Stream of a text: its words with A-Z lower-cased, a space after each, then one end byte. The model is a trie of byte
contexts up to ``ORDER``. A byte that the longest context has not seen is coded by an escape (half a count of every distinct
symbol seen there) to the next shorter context, in which the symbols that the longer one has seen are excluded; below the
empty context all remaining byte values are equally likely. The probabilities of all 256 continuations sum to one everywhere.

Training is pretrained over the whole training part: every task counts its byte runs and words, sends them packed by bucket,
and the buckets are added up; the counts grow with the corpus and never pass through one task. A bucket holds all runs (context of
``ORDER`` bytes and symbol) whose contexts end in the same ``BUCKET_DEPTH`` bytes, so every longer context is whole there; the shorter ones
are one small table (at most 65,536 pairs of bytes). Sorted runs are packed byte plane by byte plane: one to two bytes each.

Every context counts. Those with at least ``CONTEXT_SHARE`` of all positions are sent to every task: at most ``ORDER / CONTEXT_SHARE``
at every corpus size, with the symbols seen there. Positions whose longest context is among them are scored in the task. The runs of
all others are sent, packed, to their bucket, which holds what is needed to cost them exactly.

Word counts for the base score: words with at least ``WORD_SHARE`` of all tokens (at most ``1 / WORD_SHARE``, a proven bound)
are looked up in the task; all other tokens are sent, packed, to the bucket that holds their word's count. No word that
is left is frequent, so buckets stay even.

Defined results: a null text is empty; an empty text has the end token alone; repeated rows score alike; without training
rows every byte is equally likely and no token is known; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm import common
from loanscope.session import staged

ORDER = 6
BUCKET_DEPTH = 2
CONTEXT_SHARE = 1e-6
WORD_SHARE = 2e-6
END = 10  # the end byte; white space never occurs inside a word


def streams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """All texts as one stream, each after ``order`` end bytes; the position after each text; the words."""
    starts, ends, first = common.word_bounds(data, offsets)
    length = ends - starts
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    before = np.concatenate([[0], np.cumsum(length + 1)])
    at = before[:-1] + text * (order + 1) + order
    stream = np.full(int(before[-1]) + n * (order + 1), 32, np.uint8)
    stream[common.ranges(at, length)] = common.LOWER[data[common.ranges(starts, length)]]
    stop = before[first[1:]] + np.arange(1, n + 1) * (order + 1)
    stream[stop - 1] = END
    begin = np.concatenate([[0], stop[:-1]])
    stream[(begin[:, None] + np.arange(order)).ravel()] = END
    return stream, stop, (starts, ends, first)


def gram_keys(stream: np.ndarray, stop: np.ndarray, order: int) -> np.ndarray:
    """``order`` + 1 bytes up to each coded position as a number."""
    key = np.zeros(len(stream) - order, np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | stream[k : len(stream) - order + k]
    coded = np.ones(len(key), bool)  # positions `order` and on; the bytes in front of a text are not coded
    fronts = (stop[:-1, None] + np.arange(order)).ravel() - order
    coded[fronts[fronts < len(key)]] = False
    return key[coded]


def count_corpus(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, int]:
    """(bucket, keys, counts, total) of grams and (bucket, words, counts) of words with packed arrays, and the number of texts, over
    all rows of ``docs``."""
    spark = docs.sparkSession
    parts = common.shuffle_parts(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"gram": [], "word": []}
        texts = 0

        def merge(kind: str) -> None:
            held[kind] = [common.summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))]

        for part in common.slices(batches):
            data, offsets = common.raw_text(part.column("text"))
            texts += part.num_rows
            stream, stop, (starts, ends, _) = streams(data, offsets, order)
            folded = common.LOWER[data]
            for kind, keys in (("gram", gram_keys(stream, stop, order)), ("word", common.word_hashes(folded, starts, ends))):
                held[kind].append(np.unique(keys, return_counts=True))
                if len(held[kind]) > 4:
                    merge(kind)
        for kind in held:
            if not held[kind]:
                continue
            merge(kind)
            keys, counts = held[kind].pop()
            dealt, edges = common.deal(bucket_hash(keys, order) if kind == "gram" else keys, parts)
            keys, counts = keys[dealt], counts[dealt].astype(np.int64)
            full = np.flatnonzero(np.diff(edges))
            yield packed(kind, full, [keys[edges[b] : edges[b + 1]] for b in full], [counts[edges[b] : edges[b + 1]] for b in full])
        if texts:
            yield packed("text", np.array([0]), [np.zeros(1, np.uint64)], [np.array([texts], np.int64)])

    def packed(kind, buckets, keys, counts) -> pa.RecordBatch:
        small = kind == "gram"
        return pa.record_batch({
            "kind": pa.array([kind] * len(buckets)), "bucket": pa.array(buckets.astype(np.int32)),
            "keys": pa.array([pack_planes(k, order + 1) if small else k.tobytes() for k in keys], pa.binary()),
            "counts": pa.array([pack_planes(c, 8) if small else c.tobytes() for c in counts], pa.binary()),
            "total": pa.array([int(c.sum()) for c in counts], pa.int64())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for kind, bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "keys", "counts"))):
                one = held.setdefault((kind, bucket), [])
                one.append((unpack_planes(keys, order + 1), unpack_planes(counts, 8).astype(np.int64)) if kind == "gram"
                           else (np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
                if len(one) > 16:
                    held[kind, bucket] = [merged(one)]
        for (kind, bucket), one in held.items():
            keys, counts = merged(one)
            yield packed(kind, np.array([bucket]), [keys], [counts])

    def merged(one: list) -> tuple[np.ndarray, np.ndarray]:
        return common.summed(np.concatenate([k for k, _ in one]), np.concatenate([c for _, c in one]))

    schema = "kind string, bucket int, keys binary, counts binary, total long"
    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
    counts = staged(sent.repartitionById(parts, F.col("bucket")).mapInArrow(add, schema), "ppm-counts")
    texts = counts.filter("kind = 'text'").agg(F.sum("total")).first()[0]
    words = counts.filter("kind = 'word'").select("bucket", F.col("keys").alias("words"), "counts")
    return counts.filter("kind = 'gram'").drop("kind"), words, int(texts or 0)


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def tail(grams: np.ndarray, depth: int) -> np.ndarray:
    """Context of ``depth`` bytes and symbol."""
    return grams & np.uint64((1 << (8 * (depth + 1))) - 1)


def context_of(grams: np.ndarray, depth: int) -> np.ndarray:
    return tail(grams, depth) >> np.uint64(8)


def bucket_hash(grams: np.ndarray, order: int) -> np.ndarray:
    """All grams whose contexts end in the same bytes have the same hash."""
    return common.mix(context_of(grams, min(BUCKET_DEPTH, order)))


def pack_planes(values: np.ndarray, size: int) -> bytes:
    """Numbers byte by byte, first bytes first, compressed: sorted or small ones become short."""
    bytes_ = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(bytes_.T).tobytes())


def unpack_planes(data: bytes, size: int) -> np.ndarray:
    part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    whole = np.zeros((part.shape[1], 8), np.uint8)
    whole[:, 8 - size :] = part.T
    return whole.view(">u8").ravel().astype(np.uint64)


def escape_cost(kinds: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Half a count of every distinct symbol goes to the escape."""
    return np.where(kinds > 0, -np.log10(np.maximum(kinds, 1) / (2 * np.maximum(totals, 1))), 0.0)


class Trie:
    """Counts by depth of some contexts and of all that they end in, and the costs that follow from them."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        """``nodes[k]``: sorted contexts of ``k`` bytes with their symbol, and counts."""
        self.nodes = nodes
        self.contexts: list[tuple[np.ndarray, ...]] = []  # context, total, kinds; and of the next shorter one what was not seen here
        for k, (keys, n) in enumerate(nodes):
            context = keys >> np.uint64(8)
            new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            if not len(new):
                self.contexts.append((context, *[np.zeros(0)] * 4))
                continue
            total, kinds = np.add.reduceat(n, new), np.diff(np.concatenate([new, [len(keys)]]))
            left_total, left_kinds = np.zeros(len(new)), np.zeros(len(new))
            if k:
                shorter, up_total, up_kinds = self.contexts[k - 1][:3]
                at = found(shorter, context_of(keys[new], k - 1))
                seen = np.add.reduceat(self.counts(keys, k - 1), new)
                left_total, left_kinds = up_total[at] - seen, up_kinds[at] - kinds
            self.contexts.append((context[new], total, kinds, left_total, left_kinds))

    @property
    def order(self) -> int:
        return len(self.nodes) - 1

    def counts(self, grams: np.ndarray, k: int) -> np.ndarray:
        keys, n = self.nodes[k]
        at = found(keys, tail(grams, k))
        return np.where(at >= 0, n[at], 0) if len(n) else np.zeros(len(grams))

    def holds(self, grams: np.ndarray) -> np.ndarray:
        return found(self.contexts[-1][0], context_of(grams, self.order)) >= 0

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Negative log10 probability of the symbol of each gram after its context.

        A symbol that a context has not seen is coded by an escape to the next shorter one without the symbols seen here; below the
        empty context all byte values that were never seen share what is left. Contexts never seen are passed over.
        """
        cost = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        escaped = np.zeros(len(grams), bool)
        total, kinds = np.zeros(len(grams)), np.zeros(len(grams))  # of the next shorter context, without what was seen above
        for k in range(self.order, -1, -1):
            context, all_total, all_kinds, left_total, left_kinds = self.contexts[k]
            at = found(context, context_of(grams[open_], k))
            i, at = open_[at >= 0], at[at >= 0]
            t, m = (np.where(escaped[i], x[i], y[at]) if len(y) else x[i] for x, y in ((total, all_total), (kinds, all_kinds)))
            n = self.counts(grams[i], k)
            cost[i] += np.where(n > 0, -np.log10(np.maximum(n - 0.5, 0.5) / np.maximum(t, 1)), escape_cost(m, t))
            going = n == 0
            escaped[i[going]] = True
            if len(at):
                total[i[going]], kinds[i[going]] = left_total[at[going]], left_kinds[at[going]]
            coded = np.zeros(len(grams), bool)
            coded[i[~going]] = True
            open_ = open_[~coded[open_]]
            if not len(open_):
                break
        cost[open_] += np.log10(max(256 - len(self.nodes[0][0]), 1))
        return cost


def deepened(grams: np.ndarray, n: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]], order: int) -> Trie:
    """The trie of the whole grams of a bucket above the table of short contexts."""
    deeper = []
    for k in range(order, len(short) - 1, -1):
        grams, n = common.summed(tail(grams, k), n)
        deeper.append((grams, n))
    return Trie(short + deeper[::-1])


def short_contexts(grams: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the contexts that are shorter than what makes a bucket: at most 256 ** BUCKET_DEPTH pairs."""
    depth = min(BUCKET_DEPTH - 1, order)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, n = common.summed(tail(unpack_planes(keys, order + 1), depth), unpack_planes(n, 8).astype(np.int64))
                yield pa.record_batch({"gram": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    rows = grams.select("keys", "counts").mapInArrow(shorten, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    keys, n = common.summed(rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy())
    nodes = []
    for k in range(depth, -1, -1):
        keys, n = common.summed(tail(keys, k), n)
        nodes.append((keys, n))
    return nodes[::-1]


def frequent_contexts(grams: DataFrame, short: list[tuple[np.ndarray, np.ndarray]], order: int, share: float) -> Trie:
    """The contexts with at least ``share`` of all positions, with all symbols seen there."""
    least = share * int(short[0][1].sum())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, n = unpack_planes(keys, order + 1), unpack_planes(n, 8).astype(np.int64)
                for k in range(order, len(short) - 1, -1):
                    keys, n = common.summed(tail(keys, k), n)
                    context = keys >> np.uint64(8)
                    new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    often = np.repeat(np.add.reduceat(n, new) >= least, np.diff(np.concatenate([new, [len(keys)]])))
                    if often.any():
                        yield pa.record_batch({"depth": pa.array([k], pa.int32()), "keys": pa.array([pack_planes(keys[often], order + 1)], pa.binary()),
                                               "counts": pa.array([pack_planes(n[often], 8)], pa.binary())})

    kept = grams.select("keys", "counts").mapInArrow(keep, "depth int, keys binary, counts binary").toArrow()
    deeper: list[list] = [[] for _ in range(len(short), order + 1)]
    for depth, keys, n in zip(*(kept.column(c).to_pylist() for c in ("depth", "keys", "counts"))):
        deeper[depth - len(short)].append((unpack_planes(keys, order + 1), unpack_planes(n, 8).astype(np.int64)))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Trie(short + [common.summed(*map(np.concatenate, zip(*(one or [none])))) for one in deeper])


@dataclass
class LanguageModel:
    contexts: Trie  # the frequent ones
    short: list[tuple[np.ndarray, np.ndarray]]
    grams: DataFrame  # bucket, keys, counts: all of them
    words: DataFrame  # bucket, words, counts
    frequent: tuple[np.ndarray, np.ndarray]
    tokens: int
    distinct: int
    texts: int
    parts: int


def train(docs: DataFrame, order: int = ORDER, context_share: float = CONTEXT_SHARE, word_share: float = WORD_SHARE) -> LanguageModel:
    spark = docs.sparkSession
    grams, words, texts = count_corpus(docs, order)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(c, np.int64) for c in batch.column("counts").to_pylist()]
            yield pa.record_batch({"tokens": pa.array([int(c.sum()) for c in counts], pa.int64()),
                                   "distinct": pa.array([len(c) for c in counts], pa.int64())})

    total = words.select("counts").mapInArrow(sizes, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = int(total[0] or 0) + texts, int(total[1] or 0) + (texts > 0)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                w, c = np.frombuffer(w, np.int64), np.frombuffer(c, np.int64)
                yield pa.record_batch({"word": pa.array(w[c >= word_share * tokens]), "n": pa.array(c[c >= word_share * tokens])})

    found = words.select("words", "counts").mapInArrow(often, "word long, n long").toArrow()
    word = found.column("word").to_numpy().view(np.uint64)
    by = np.argsort(word)
    frequent = (word[by], found.column("n").to_numpy()[by])
    short = short_contexts(grams, order)
    contexts = frequent_contexts(grams, short, order, context_share)
    return LanguageModel(contexts, short, grams, words, frequent, tokens, distinct, texts, common.shuffle_parts(spark))


def known(words: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Count of each word in a sorted table, 0 where it is absent."""
    keys, counts = table
    if not len(keys):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, counts[at], 0)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.contexts, model.frequent))
    low = spark.sparkContext.broadcast(model.short)
    parts, end_count, order = model.parts, model.texts, model.contexts.order

    def held_scores(stream, stop, contexts: Trie) -> tuple[np.ndarray, tuple]:
        """Score of each text over positions whose longest context is held; the other grams, how often each occurs, and in which texts."""
        begin = np.concatenate([[0], stop[:-1]]) + order
        text = np.repeat(np.arange(len(stop)), stop - begin)
        grams, place = np.unique(gram_keys(stream, stop, order), return_inverse=True)
        here = contexts.holds(grams)
        cost = np.zeros(len(grams))
        cost[here] = contexts.cost(grams[here])
        rest = np.flatnonzero(~here[place])
        by = rest[np.argsort(place[rest], kind="stable")]
        return -np.bincount(text, cost[place], len(stop)), (grams[~here], np.bincount(place[by], minlength=len(grams))[~here], text[by])

    def gram_asks(first_row, n, grams, times, texts) -> pa.RecordBatch:
        by, edges = common.deal(bucket_hash(grams, order), parts)  # stable, so the grams of a bucket stay sorted
        full = np.flatnonzero(np.diff(edges))
        begin = np.concatenate([[0], np.cumsum(times)[:-1]])
        dealt = [by[edges[b] : edges[b + 1]] for b in full]
        size = 2 if n <= 1 << 16 else 4
        return asks(full, first_row, [pack_planes(grams[d], order + 1) for d in dealt],
                    [pack_planes(texts[common.ranges(begin[d], times[d])], size) for d in dealt], [pack_planes(times[d], 4) for d in dealt])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, frequent = shared.value
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        turn = 0
        for part in common.slices(batches):
            data, offsets = common.raw_text(part.column("text"))
            n = part.num_rows
            row = base + turn + np.arange(n, dtype=np.int64)
            turn += n
            stream, stop, (starts, ends, first) = streams(data, offsets, order)
            value, rest = held_scores(stream, stop, contexts)
            if len(rest[0]):
                yield gram_asks(int(row[0]), n, *rest)
            words = common.word_hashes(common.LOWER[data], starts, ends)
            count = known(words, frequent)
            there = count > 0
            # tokens of frequent words and the end token count here, the others in their bucket
            logs = np.concatenate([[0.0], np.cumsum(np.where(there, np.log10(count + 0.5), 0.0))])
            hits = np.concatenate([[0], np.cumsum(there)])
            yield rows_of(row, part.column("doc_id").cast(pa.int64()), np.diff(first) + 1,
                          hits[first[1:]] - hits[first[:-1]] + (end_count > 0),
                          logs[first[1:]] - logs[first[:-1]] + np.log10(end_count + 0.5), value)
            rare = np.flatnonzero(~there)
            if len(rare):
                text = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))[rare]
                dealt, edges = common.deal(words[rare], parts)
                w, t = words[rare][dealt], text[dealt]
                full = np.flatnonzero(np.diff(edges))
                yield asks(full, int(row[0]), [w[edges[b] : edges[b + 1]].tobytes() for b in full], [t[edges[b] : edges[b + 1]].tobytes() for b in full])

    def rows_of(row, doc_id, n_tokens, n_known, base, value) -> pa.RecordBatch:
        n = len(row)
        return pa.record_batch({
            "row": pa.array(row), "doc_id": doc_id, "n_tokens": pa.array(n_tokens.astype(np.int64)),
            "n_known": pa.array(n_known.astype(np.int64)), "base": pa.array(base), "score": pa.array(value),
            "bucket": pa.nulls(n, pa.int32()), "words": pa.nulls(n, pa.binary()), "texts": pa.nulls(n, pa.binary()),
            "times": pa.nulls(n, pa.binary())})

    def asks(buckets, first_row, words, texts, times=None) -> pa.RecordBatch:
        n = len(buckets)
        return pa.record_batch({
            "row": pa.array([first_row] * n, pa.int64()), "doc_id": pa.nulls(n, pa.int64()),
            "n_tokens": pa.nulls(n, pa.int64()), "n_known": pa.nulls(n, pa.int64()), "base": pa.nulls(n, pa.float64()),
            "score": pa.nulls(n, pa.float64()), "bucket": pa.array(buckets.astype(np.int32)),
            "words": pa.array(words, pa.binary()), "texts": pa.array(texts, pa.binary()),
            "times": pa.array(times or [None] * n, pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple] = {}
        waiting: dict[int, list] = {}
        for batch in batches:
            for bucket, row, words, other in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "words", "other"))):
                words = np.frombuffer(words, np.uint64)
                if row is None:
                    tables[bucket] = (words, np.frombuffer(other, np.int64))  # sorted when they were added up
                else:
                    waiting.setdefault(bucket, []).append((row, words, np.frombuffer(other, np.int32)))
        for bucket, asked in waiting.items():
            table = tables.get(bucket, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            rows = []
            for row, words, texts in asked:
                count = known(words, table)
                some = np.flatnonzero(np.bincount(texts))
                # all answers to one slice meet in one place
                rows.append((int(common.mix(np.array([row], np.uint64))[0] % np.uint64(parts)), (row + some).tobytes(),
                             np.bincount(texts, count > 0)[some].astype(np.int64).tobytes(),
                             np.bincount(texts, np.log10(count + 0.5))[some].tobytes(), np.zeros(len(some)).tobytes()))
            columns = list(zip(*rows))
            yield pa.record_batch({"bucket": pa.array(columns[0], pa.int32())} | {
                c: pa.array(columns[i], pa.binary()) for i, c in enumerate(("rows", "n", "log", "score"), 1)})

    def gram_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a bucket come sorted: its training grams first
        bucket, table, trie, asked, size = None, [], None, [], 0

        def answers() -> pa.RecordBatch:
            grams = np.concatenate([a[1] for a in asked])
            distinct, place = np.unique(grams, return_inverse=True)
            cost = trie.cost(distinct)[place]
            rows, at = [], 0
            for row, own, times, texts in asked:
                each = np.repeat(cost[at : at + len(own)], times)
                at += len(own)
                some = np.flatnonzero(np.bincount(texts))
                rows.append((int(common.mix(np.array([row], np.uint64))[0] % np.uint64(parts)), (row + some).tobytes(),
                             np.zeros(len(some), np.int64).tobytes(), np.zeros(len(some)).tobytes(),
                             (-np.bincount(texts, each)[some]).tobytes()))
            columns = list(zip(*rows))
            return pa.record_batch({"bucket": pa.array(columns[0], pa.int32())} | {
                c: pa.array(columns[i], pa.binary()) for i, c in enumerate(("rows", "n", "log", "score"), 1)})

        for batch in batches:
            for b, row, keys, other, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "words", "other", "times"))):
                if b != bucket:
                    if asked:
                        yield answers()
                    bucket, table, trie, asked, size = b, [], None, [], 0
                if row is None:
                    table.append((unpack_planes(keys, order + 1), unpack_planes(other, 8).astype(np.int64)))
                    continue
                if trie is None:
                    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    trie = deepened(*(np.concatenate(x) for x in zip(*(table or [none]))), low.value, order)
                    table = []
                times = unpack_planes(times, 4).astype(np.int64)
                texts = unpack_planes(other, zstandard.frame_content_size(other) // int(times.sum())).astype(np.int64)
                asked.append((row, unpack_planes(keys, order + 1), times, texts))
                size += len(texts)
                if size > 1 << 20:
                    yield answers()
                    asked, size = [], 0
        if asked:
            yield answers()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(r, np.int64), np.frombuffer(n, np.int64), np.frombuffer(x, np.float64), np.frombuffer(y, np.float64))
                for batch in batches for r, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("rows", "n", "log", "score")))]
        if held:
            row, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n, log, more = (np.bincount(place, np.concatenate([h[i] for h in held]), len(row)) for i in (1, 2, 3))
            yield pa.record_batch({"row": pa.array(row), "more": pa.array(n.astype(np.int64)), "log": pa.array(log), "rest": pa.array(more)})

    scored = staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, bucket int, words binary, texts binary, times binary"),
        "ppm-scored")
    asked = scored.filter("bucket IS NOT NULL").select("bucket", "row", "words", F.col("texts").alias("other"), "times")
    answered = "bucket int, rows binary, n binary, log binary, score binary"

    def replies(asked: DataFrame, held: DataFrame, by) -> DataFrame:
        none = F.lit(None)
        held = held.select("bucket", none.cast("long").alias("row"), "words", F.col("counts").alias("other"), none.cast("binary").alias("times"))
        dealt = asked.unionByName(held).repartitionById(parts, F.col("bucket"))
        return (dealt.sortWithinPartitions("bucket", "row") if by is gram_answer else dealt).mapInArrow(by, answered)

    back = replies(asked.filter("times IS NULL"), model.words, answer).unionByName(
        replies(asked.filter("times IS NOT NULL"), model.grams.withColumnRenamed("keys", "words"), gram_answer))
    answers = back.repartitionById(parts, F.col("bucket")).mapInArrow(add, "row long, more long, log double, rest double")
    spread = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    return scored.filter("bucket IS NULL").join(answers, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
