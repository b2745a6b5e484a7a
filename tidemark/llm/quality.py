"""Quality rules: fixed base rules, and calibrated logistic regression on hashed word and character n-grams.

Features: words, word pairs and runs of CHARS code points of the lower-cased text, hashed to 2**BITS places;
counts are damped (1 + log) and weighed by the size of the place's log odds in training; word pairs and character
runs are scaled to length 1 each, words to a fixed value. Two models, for the labels ``quality`` and ``toxic``, are
trained by AdaGrad on labelled documents and calibrated (Platt) on held-out ones, in one task on an executor. A
document is kept if no base rule fails, P(quality) >= KEEP_QUALITY and P(toxic) < DROP_TOXIC.

The models are fitted on at most SAMPLE labelled documents, those of least hash of doc_id, and of those on the first
whose features fit in SAMPLE_BYTES; these are the only bounds. All documents are scored whole, in Arrow batches.

Defined results: null and empty texts have no words and fail the base rule; labels that are null, repeated
(the smallest counts) or without a document are ignored; of labelled rows with an equal doc_id the text of least hash
trains, once; with fewer than MIN_LABELS labels of either value a model isn't fitted and passes everything; repeated
rows give repeated results; a null doc_id is scored; an empty table gives an empty result; texts of any length are
scored whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, mixed, rows_of, shingles

BITS = 19
#: Most labelled documents to train on, and most bytes of their features.
SAMPLE, SAMPLE_BYTES = 2500, 256 << 20
#: Code points in a character run.
CHARS = 4
MIN_LABELS = 8
#: What a word counts, however long its text is: a few words of one kind can settle a long text.
WORD_VALUE = 0.25
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5
#: Characters that count as symbols. Fixed value.
SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"


def base_counts(text: str | None, hashes: WordHashes) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the words' hashes."""
    if not text:
        return (0, 0, 0, 0, 0), np.zeros(0, np.uint64)
    raw = text.encode()
    words = hashes.array(raw.split())
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, _WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    repeated = 0
    if n >= 3:
        _, back, counts = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int32)
        twice = np.flatnonzero(counts[back] > 1)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 3, -1)
        repeated = int(np.count_nonzero(np.cumsum(edge[:n])))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated), words


def features(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; ``text`` in lower case."""
    raw = text.encode()
    words = hashes.array(re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[!-/:-@\[-`{-~]+", raw))
    families = [words, shingles(words, 2) if len(words) > 1 else words[:0]]
    if len(text) >= CHARS:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        run = points[: len(points) - CHARS + 1].copy()
        for i in range(1, CHARS):  # a code point has 21 bits, so few runs collide
            run = (run << np.uint64(13)) + run + points[i : len(points) - CHARS + 1 + i]
        families.append(run)
    places, values = [], []
    for k, family in enumerate(families):
        if not len(family):
            continue
        place = (mixed(family + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.uint32)
        place.sort()
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        value = 1 + np.log(np.diff(np.r_[first, len(place)]))
        places.append(place[first])
        values.append((value * WORD_VALUE if k == 0 else value / np.sqrt(value @ value)).astype(np.float32))
    if not places:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    return np.concatenate(places), np.concatenate(values)


class Logistic:
    """Weights, bias, and the calibration's slope and shift."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, places: np.ndarray, values: np.ndarray, default: float) -> float:
        if self.weights is None:
            return default
        margin = float(self.weights[places] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def log_odds(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """How strongly each place speaks for one label: the size of its smoothed log odds; 0 where it is too rare to say."""
    counts = np.zeros((2, 1 << BITS), np.float32)
    for (places, _), label in zip(rows, labels):
        counts[label, places] += 1
    sizes = np.bincount(labels, minlength=2)
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    odds[counts.sum(0) < max(2, len(rows) // 300)] = 0
    return np.abs(odds)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.3) -> Logistic:
    """Train on four fifths of the rows, in the given order, and calibrate on the rest."""
    if min(labels.sum(), len(labels) - labels.sum()) < MIN_LABELS:
        return Logistic(None)
    held = np.arange(len(rows)) % 5 == 4
    order = np.flatnonzero(~held)
    scale = log_odds([rows[i] for i in order], labels[order])
    weights, squares, bias, bias_squares = np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, 1.0
    rng = np.random.default_rng(7)
    share = labels[order].mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(labels))
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            places, values = rows[i]
            values = values * scale[places]
            p = 1 / (1 + np.exp(-np.clip(weights[places] @ values + bias, -30, 30)))
            slope = float(balance[i] * (p - labels[i]))
            g = slope * values
            squares[places] += g * g
            weights[places] -= rate * g / np.sqrt(squares[places])
            bias_squares += slope * slope
            bias -= rate * slope / np.sqrt(bias_squares)
    weights *= scale  # for values as features() gives them
    model = Logistic(weights, float(bias))
    margins = np.array([weights[p] @ v + bias for p, v in (rows[i] for i in np.flatnonzero(held))], float)
    target, a, b = labels[held].astype(float), 1.0, 0.0
    target = target * (1 - 2 / (len(target) + 2)) + 1 / (len(target) + 2)
    for _ in range(100):  # Newton steps of the two-parameter fit
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * margins).sum() + 0.1 * (a - 1), (p - target).sum()])
        hess = np.array([[(w * margins * margins).sum() + 0.1, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[Logistic, Logistic]:
    """The models of ``quality`` and ``toxic``: features are made where the texts are, one task fits both."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct("quality", "toxic")).alias("y"))
    # at most ``sample`` rows of three numbers
    chosen = marks.select("doc_id", F.col("y.quality").cast("int").alias("quality"), F.col("y.toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")
    # one text a document, whatever is repeated; copies are dropped before the shuffle too
    single = labelled.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [(d, q, t, *(x.tobytes() for x in features(text.lower(), hashes))) for d, q, t, text in rows_of(batch)]
            if rows:
                kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["doc_id", "quality", "toxic", "places", "values"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, held = [], [], 0
        for batch in batches:
            for _, quality, toxic, places, values in rows_of(batch):
                held += len(places) + len(values)
                if held <= sample_bytes:
                    rows.append((np.frombuffer(places, np.uint32), np.frombuffer(values, np.float32)))
                    marks.append((quality, toxic))
        if rows:
            for k, label in enumerate(("quality", "toxic")):
                m = fit(rows, np.array([x[k] for x in marks], int))
                weights = None if m.weights is None else m.weights.astype(np.float16).tobytes()
                kinds, names = [pa.string(), pa.binary(), *[pa.float64()] * 3], ["label", "weights", "bias", "slope", "shift"]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((label, weights, m.bias, m.slope, m.shift), kinds)], names)

    made = single.mapInArrow(run, "doc_id long, quality int, toxic int, places binary, values binary")
    # at most ``sample`` rows meet in this task
    together = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = {r.label: r for r in together.mapInArrow(fitted, "label string, weights binary, bias double, slope double, shift double").collect()}
    own = lambda r: Logistic(None if r.weights is None else np.frombuffer(r.weights, np.float16), r.bias, r.slope, r.shift)
    return tuple(own(got[k]) if k in got else Logistic(None) for k in ("quality", "toxic"))


class Judge:
    """Base counts and both probabilities of single texts; made once per Python worker."""

    def __init__(self, models: list[tuple]):
        self.good, self.toxic = (Logistic(None if w is None else w.astype(np.float32), *rest) for w, *rest in models)
        self.hashes, self.lower = WordHashes(100_000), WordHashes(100_000)

    def __call__(self, text: str | None) -> tuple:
        (n, chars, symbols, dup, repeated), _ = base_counts(text, self.hashes)
        failed = n < 50 or 100 * repeated > 50 * n
        places, values = features((text or "").lower(), self.lower)
        p, q = self.good.probability(places, values, 1.0), self.toxic.probability(places, values, 0.0)
        return n, chars, symbols, dup, repeated, failed, not failed and p >= KEEP_QUALITY and q < DROP_TOXIC, p, q


def _models(docs: DataFrame, labels: DataFrame, sample: int):
    """A broadcast of both models: 2**BITS half-precision weights each."""
    models = train(docs, labels, sample)
    return docs.sparkSession.sparkContext.broadcast([(m.weights, m.bias, m.slope, m.shift) for m in models])


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a shuffle."""
    models, at = _models(documents(docs), labels, sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(models.value)
        for batch in batches:
            yield batch.filter(pa.array([judge(x[0])[6] for x in rows_of(batch.select([at]))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The base counts, base_failed, p_quality, p_toxic and kept of each document."""
    docs = documents(docs)
    models = _models(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(models.value)
        for batch in batches:
            rows = [(doc_id, *judge(text)) for doc_id, text in rows_of(batch)]
            if rows:
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality", "p_toxic"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, p_quality double, p_toxic double")
