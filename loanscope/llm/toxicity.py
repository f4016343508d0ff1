"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

One dictionary is trained on labelled ordinary text, the other on what is typical of labelled toxic text: the runs of words and pairs that are
``RARER`` times rarer in ordinary rows, each counted by how many different words stand before it. Rarer, not absent, so that mislabelled
or quoting rows do not strike words out. Both end with the ordinary part, byte for byte, so a window of ordinary words is as
long under either one, and a window with toxic words is shorter under the toxic one. Where there is too little text to choose from, a
dictionary is all of it, the frequent parts last, where matches are cheapest.

How much likelier a difference is in toxic texts than in ordinary ones is calibrated on training rows that the dictionaries have not seen; a
document's features are the sum, the largest and the mean excess of these log ratios over all its windows. A logistic curve over
them gives the score, with the cut where training errors weigh least; of equal cuts the middle one. Where no cut is much better than rejecting
nothing, nothing is rejected.

Fitting uses a bounded sample of labelled rows: ``SAMPLE_ROWS`` of each class in the order of a hash, of texts above ``SAMPLE_TEXT_BYTES`` a
piece at a place given by a hash. Scoring reads every whole text.

Defined results: null and empty texts have no window and get the score of a text without differences; if no row of either
class is labelled every score is 0; repeated rows score alike; language, source, label and id are no inputs; rows
with a null id are scored but never dropped; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.llm import common

WINDOW_WORDS = 6
SAMPLE_ROWS = 4000
SAMPLE_TEXT_BYTES = 16 << 10
SHARED_BYTES = 24 << 10
TOXIC_BYTES = 24 << 10
LEVEL = 13
LEAST_SAVED, MOST_SAVED = -10, 14  # differences beyond these bytes count as these
MAX_SUM = 20.0
RARER = 10  # how many times rarer in ordinary text than in toxic text
CLEAN_WEIGHT = 2.0  # a clean document rejected counts as so many toxic ones missed
USEFUL = 0.7  # a cut with more errors than this share of the smaller class rejects nothing


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    ratios: tuple[float, ...]  # log likelihood ratio of each difference from LEAST_SAVED to MOST_SAVED
    weights: tuple[float, ...]  # intercept first; empty where nothing could be fitted


def window_spans(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and text number of consecutive windows of ``width`` words."""
    starts, ends, first = common.word_bounds(data, offsets)
    counts = np.diff(first)
    step = width
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - width) // step) + 1), 0)
    text = np.repeat(np.arange(len(counts)), windows)
    nth = common.ranges(np.zeros(len(counts), np.int64), windows)
    begin = first[:-1][text] + nth * step
    last = np.minimum(begin + width, first[1:][text]) - 1
    return starts[begin], ends[last], text


def compressed_sizes(low: np.ndarray, begin: np.ndarray, end: np.ndarray, dictionary: bytes) -> np.ndarray:
    """Compressed length of every window."""
    packer = packer_for(dictionary)
    sizes = []
    for k in range(0, len(begin), 1 << 15):
        span = np.stack([begin[k : k + (1 << 15)], end[k : k + (1 << 15)] - begin[k : k + (1 << 15)]], axis=1).astype(np.uint64)
        lo = int(span[0, 0])
        hi = int(end[k : k + (1 << 15)].max())
        span[:, 0] -= np.uint64(lo)
        segments = zstandard.BufferWithSegments(low[lo:hi].tobytes(), span.tobytes())
        done = packer.multi_compress_to_buffer(segments)
        sizes.append(np.fromiter(map(len, done), np.int64, len(done)))
    return np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)


_packers: dict[bytes, zstandard.ZstdCompressor] = {}


def packer_for(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _packers:
        if len(_packers) > 4:
            _packers.clear()
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        content.precompute_compress(compression_params=settings)
        _packers[dictionary] = zstandard.ZstdCompressor(dict_data=content, compression_params=settings)
    return _packers[dictionary]


def differences(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the toxic dictionary saves in each window, and the window's text."""
    begin, end, text = window_spans(data, offsets)
    low = common.LOWER[data]
    low = np.where(common.IS_SPACE[low], np.uint8(32), low)
    saved = (compressed_sizes(low, begin, end, model.ordinary) - compressed_sizes(low, begin, end, model.toxic))
    return np.clip(saved, LEAST_SAVED, MOST_SAVED) - LEAST_SAVED, text


def features(saved: np.ndarray, text: np.ndarray, n: int, ratios: tuple[float, ...]) -> np.ndarray:
    """Per text: sum and largest of the log ratios, root of their mean excess."""
    result = np.zeros((n, 3))
    if len(saved):
        ratio = np.array(ratios)[saved]
        edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        size = np.diff(np.concatenate([edges, [len(text)]]))
        result[text[edges]] = np.stack([
            np.clip(np.add.reduceat(ratio, edges), -MAX_SUM, MAX_SUM), np.maximum.reduceat(ratio, edges),
            np.sqrt(np.add.reduceat(np.maximum(ratio, 0.0), edges) / size)], axis=1)
    return result


def shares(saved: np.ndarray) -> np.ndarray:
    counts = np.bincount(saved, minlength=MOST_SAVED - LEAST_SAVED + 1) + 0.5
    return counts / counts.sum()


def fit(ordinary: list[str], toxic: list[str]) -> ToxicityModel:
    """Train the dictionaries on one half of the sample, the curve on the other half."""
    if not ordinary or not toxic:
        return ToxicityModel(b"", b"", (), ())
    o_text, t_text = [[" ".join(words_of(x)) for x in part] for part in (ordinary, toxic)]
    o_train, o_rest = o_text[::2], o_text[1::2] or o_text
    t_train, t_rest = t_text[::2], t_text[1::2] or t_text
    shared = trained(o_train, SHARED_BYTES)
    special = trained(toxic_runs(t_train, o_train), TOXIC_BYTES)
    # both have the ordinary part at the end, at the same distance from the window
    filler = trained(o_train[::-1], len(special))[-len(special):].rjust(len(special))
    model = ToxicityModel(filler + shared, special + shared, (), ())
    saved_o, text_o = differences(*buffer_of(o_rest), model)
    saved_t, text_t = differences(*buffer_of(t_rest), model)
    ratios = tuple(np.log(shares(saved_t)) - np.log(shares(saved_o)))
    x = np.concatenate([features(saved_o, text_o, len(o_rest), ratios), features(saved_t, text_t, len(t_rest), ratios)])
    y = np.concatenate([np.zeros(len(o_rest)), np.ones(len(t_rest))])
    return ToxicityModel(model.ordinary, model.toxic, ratios, tuple(logistic(x, y)))


def numbered(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of every word, of the one before it (0 at a text's start) and after it (0 at its end), and the texts' offsets."""
    words = [t.split(" ") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids = np.fromiter((number.setdefault(x, len(number) + 1) for w in words for x in w), np.int64, int(offsets[-1]))
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    before[offsets[:-1]], after[offsets[1:] - 1] = 0, 0
    return ids, before, after, offsets


def supports(units: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """After how many different words each of ``n`` units occurs: copies of one text say the same thing once."""
    return np.bincount(np.unique(before * n + units) % n, minlength=n)


def toxic_runs(toxic: list[str], ordinary: list[str]) -> list[str]:
    """What the toxic dictionary is trained on: the runs of words of toxic texts that are much rarer in ordinary ones.

    Rarer, not absent: some ordinary rows may be mislabelled or quote such words.
    """
    number: dict[str, int] = {}
    t, o = numbered(toxic, number), numbered(ordinary, number)
    n = len(number) + 1
    share = len(toxic) / len(ordinary)
    # what n ordinary texts lack may still be in about 1 / n of them: ask for more than that could bring
    least = 5 + 8 * share
    of_toxic, of_ordinary = (supports(x[0], x[1], n) for x in (t, o))
    typical = (of_toxic >= least) & (of_toxic >= RARER * share * of_ordinary)
    # a pair says something of its own only where none of its words does
    keys, place = np.unique(np.concatenate([x[0] * n + x[2] for x in (t, o)]), return_inverse=True)
    pairs = place[: len(t[0])], place[len(t[0]) :]
    pair_toxic, pair_ordinary = (supports(p, x[1], len(keys)) for p, x in zip(pairs, (t, o)))
    alone = (keys % n > 0) & ~typical[keys // n] & ~typical[keys % n]
    typical_pair = alone & (pair_toxic >= 4 * least) & (pair_toxic >= RARER * share * pair_ordinary)
    if not typical.any() and not typical_pair.any():
        value = of_toxic / (of_ordinary + 1)
        typical[min((w, i) for w, i in number.items() if value[i] == value.max())[1]] = True
    marked = typical[t[0]]
    first = typical_pair[pairs[0]]
    marked |= first | np.concatenate([[False], first[:-1]])
    out = []
    for text, x, y in zip(toxic, t[3][:-1], t[3][1:]):
        words = text.split(" ")
        out += [" ".join(words[a:b]) + " " for a, b in stretches(marked[x:y])]
    return out


def stretches(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_FOLD).split(" ") if w]


_FOLD = {i: i + 32 for i in range(65, 91)} | {b: " " for b in common.SPACE_BYTES}


def buffer_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return common.raw_text(pa.array(texts, pa.string()))


def trained(texts: list[str], size: int) -> bytes:
    """Content of a dictionary trained on the texts; the texts themselves where they are too few to train on."""
    coded = [t.encode() for t in texts]
    samples = [t[k : k + 512] for t in coded for k in range(0, len(t), 512)]
    if sum(map(len, samples)) > 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    # too little to choose from: all of it, what is there often last
    often = sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))
    return b"".join(x for x, _ in often)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method with classes balanced to their shares; the intercept is moved to the cut with fewest errors."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(a) * np.eye(len(w))
        w = w + np.linalg.solve(hess, a.T @ (weight * (y - p)) - ridge * len(a) * w)
    margin = a @ w
    w[0] -= safe_cut(margin, y)
    return w


def safe_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin with the least weight of errors, the middle one of equal ones; above all margins where it is hardly better than to reject none."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    wrong = np.where(t == 0, CLEAN_WEIGHT, 1.0)
    above, below = np.sum(wrong[t == 0]) - np.cumsum(wrong * (t == 0)), np.cumsum(wrong * (t == 1))
    errors = np.concatenate([[np.sum(wrong[t == 0])], above + below])
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    errors = np.where(np.concatenate([[True], m[1:] > m[:-1], [True]]), errors, np.inf)
    if errors.min() > USEFUL * np.sum(t == 1):
        return float(m[-1] + 1)
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[len(best) // 2]])


def score_texts(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> np.ndarray:
    n = len(offsets) - 1
    if not model.weights:
        return np.zeros(n)
    saved, text = differences(data, offsets, model)
    x = features(saved, text, n, model.ratios)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, in_training: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on labelled rows; ``in_training`` is a condition on doc_id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if in_training is not None:
        known = known.filter(in_training)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    text = F.col("text").cast("string")
    piece = SAMPLE_TEXT_BYTES // 4  # characters, which have at most four bytes
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length(text) - piece, F.lit(1))).cast("int") + 1
    texts = (docs.select("doc_id", F.when(F.octet_length(text) <= SAMPLE_TEXT_BYTES, text).otherwise(text.substr(place, F.lit(piece))).alias("text"))
             .filter(F.col("text").isNotNull())
             .join(F.broadcast(sample), "doc_id"))  # at most two times sample_rows ids
    rows = texts.select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending")]).to_pylist()
    return fit([r["text"] for r in rows if r["toxic"] == 0], [r["text"] for r in rows if r["toxic"] == 1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            value = score_texts(*common.raw_text(part.column("text")), model)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "score": pa.array(value),
                                   "predicted": pa.array((value >= 0.5).astype(np.int32))})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, all their columns: scored and sifted in one pass."""
    model = train(docs, labels, common.crc_fold("doc_id") != 0, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            clean = score_texts(*common.raw_text(part.column("text")), model) < 0.5
            yield part.filter(pa.array(clean | part.column("doc_id").is_null().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
