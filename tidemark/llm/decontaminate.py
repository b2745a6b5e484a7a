"""Benchmark decontamination: BM25 over test items by block-max WAND, every passage of the corpus a query.

Test items are the indexed documents; their number, mean length and the documents of each word are counted over all
items. A posting's impact is divided by the item's score for its own text, so a score is the share of an item that a
passage covers, and one limit serves all items. Items are indexed by length class (the next power of two of their
words), and a class's passages are two neighbouring chunks of that many words: a whole copy always lies in one passage,
and one long item doesn't make the passages of short ones longer.

Per passage: block maxima (over BLOCK items) are summed over its distinct terms; a block whose sum stays
below the limit can't hold a hit. Only passages with a live block go to the document-at-a-time search, which
moves a pivot over posting lists in item order and skips what the term and block maxima rule out. What it
retrieves is verified: of the item's question and of its answer, each, the passage must have VERIFY of the words in runs
of GRAM words (of half the part, if that is less). So a changed word costs itself alone, not all runs around it.

An item's answer is what follows a line mark ("Answer:", "A:"), else its last sentence if it has more than
one, else its last quarter of words; the question is the rest.

Indexes are broadcast in parts of at most about MAX_ITEMS items, each a pass over the corpus, so what a task holds is
bounded whatever the benchmark's size. As the counts and passages don't depend on the parts, neither does any result.

Defined results: null and empty texts or items give no hit; texts of any length are searched whole; of
repeated items or rows each is reported; a document's best passage counts for an item (ties: the first); a null doc_id or
item_id is reported as it is; an empty table of documents or items gives an empty result (``keep``: all documents);
other columns are ignored, and kept by ``keep``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

LIMIT, VERIFY, GRAM = 0.6, 0.75, 3
K1, B = 1.2, 0.75
BLOCK = 4
#: Passages whose block maxima are summed up at once.
STRIP = 256
MAX_ITEMS = 2048
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer."""
    mark = list(re.finditer(r"(?im)^\s*(?:answer|a)\s*:", text))
    if mark:
        return words_of(text[: mark[-1].start()]), words_of(text[mark[-1].end() :])
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    if ends:
        return words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
    words = words_of(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def runs_of(part: list[str]) -> list[tuple[str, ...]]:
    n = min(GRAM, max(1, len(part) // 2))
    return list(zip(*(part[i:] for i in range(n))))


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's words that lie in runs that the passage has; 1 for an empty part."""
    own = runs_of(part)
    if not own:
        return 1.0
    n = len(own[0])
    there, covered = set(zip(*(passage[i:] for i in range(n)))), [False] * len(part)
    for i, run in enumerate(own):
        if run in there:
            covered[i : i + n] = [True] * n
    return sum(covered) / len(part)


@dataclass(frozen=True)
class Counts:
    """What BM25 needs of all items: their number, mean length, and the items of each word."""

    items: int
    mean: float
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[str | None]) -> Counts:
        words = [w for w in map(words_of, texts) if w]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), dict(Counter(t for w in words for t in set(w))))


def length_class(words: list[str]) -> int:
    return 1 << max(0, len(words) - 1).bit_length()


class Index:
    """Postings of items of one length class, in item order, with term and block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], size: int, counts: Counts):
        texts = [(i, t, words_of(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
        self.ids = [i for i, _, _ in texts]
        self.parts = [parts_of(t) for _, t, _ in texts]
        self.length = size
        n, frequency = counts.items, counts.frequency
        own_counts = [Counter(w) for _, _, w in texts]
        self.terms = {t: k for k, t in enumerate(sorted({t for c in own_counts for t in c}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, (count, (_, _, w)) in enumerate(zip(own_counts, texts)):
            impact = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / counts.mean)) for t, f in sorted(count.items())}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[self.terms[t]].append((k, x / own))
        self.postings = postings
        self.top = np.array([max(x for _, x in p) for p in postings] or [0.0])
        self.blocks = np.zeros((len(postings), -(-len(texts) // BLOCK) or 1), np.float32)
        for t, p in enumerate(postings):
            for k, x in p:
                self.blocks[t, k // BLOCK] = max(self.blocks[t, k // BLOCK], x)
        self.blocks *= np.float32(1 + 1e-5)  # sums in single precision stay upper bounds

    def search(self, terms: list[int], limit: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with score >= limit, for distinct query terms."""
        slack = limit - 1e-9
        lists = [[t, 0] for t in terms]
        found = []
        while True:
            lists = [x for x in lists if x[1] < len(self.postings[x[0]])]
            lists.sort(key=lambda x: self.postings[x[0]][x[1]][0])
            bound, pivot = 0.0, -1
            for i, (t, _) in enumerate(lists):
                bound += self.top[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = self.postings[lists[pivot][0]][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and self.postings[lists[pivot + 1][0]][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.blocks[t, block]) for t, _ in lists[: pivot + 1]) < slack:
                # nothing up to the block's end, or up to the next list's item, can reach the limit
                beyond = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    beyond = min(beyond, self.postings[lists[pivot + 1][0]][lists[pivot + 1][1]][0])
                self._advance(lists[: pivot + 1], max(beyond, item + 1))
            elif self.postings[lists[0][0]][lists[0][1]][0] == item:
                score = math.fsum(self.postings[t][at][1] for t, at in lists[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                self._advance(lists[: pivot + 1], item + 1)
            else:
                self._advance([x for x in lists[: pivot + 1] if self.postings[x[0]][x[1]][0] < item], item)

    def _advance(self, lists: list[list[int]], item: int) -> None:
        for x in lists:
            own = self.postings[x[0]]
            while x[1] < len(own) and own[x[1]][0] < item:
                x[1] += 1

    def within(self, vocabulary: dict[str, int]) -> Index:
        """Take words as their places in ``vocabulary`` from now on; the last place is for all other words."""
        self.term_at = np.full(len(vocabulary) + 1, -1, np.int64)
        for t, k in self.terms.items():
            self.term_at[vocabulary[t]] = k
        return self

    def hits(self, words: list[str], places: np.ndarray, limit: float = LIMIT, verify: float = VERIFY) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of each verified item."""
        if not words or not self.ids:
            return []
        size, known = self.length, self.term_at[places]
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return []
        keys = np.unique(at // size * len(self.terms) + known[at])
        chunk, term = keys // len(self.terms), keys % len(self.terms)
        chunks = -(-len(words) // size)
        starts = np.searchsorted(chunk, np.arange(chunks + 1))
        single = np.concatenate([[0.0], np.cumsum(self.top[term])])[starts]
        one = np.diff(single)
        last = max(1, chunks - 1)
        sums = one[:-1] + one[1:] if chunks > 1 else one
        best: dict[int, tuple[float, float, float, int]] = {}
        for begin in range(0, last, STRIP):
            passages = begin + np.flatnonzero(sums[begin : min(last, begin + STRIP)] >= limit - 1e-6)
            if not len(passages):
                continue
            # each chunk's block maxima: two chunks' sum is at least their passage's
            edges = starts[begin : min(chunks, begin + STRIP + 1) + 1]
            full = np.flatnonzero(np.diff(edges))
            blocks = np.zeros((len(edges), self.blocks.shape[1]), np.float32)
            blocks[full] = np.add.reduceat(self.blocks[term[edges[0] : edges[-1]]], edges[full] - edges[0])
            bound = (blocks[:-1] + blocks[1:]).max(1)
            for p in passages[bound[passages - begin] >= limit - 1e-4].tolist():
                own = np.unique(term[starts[p] : starts[min(p + 2, chunks)]])
                if self.blocks[own].sum(0).max() >= limit - 1e-5:
                    self._verified(own, words[p * size : (p + 2) * size], p * size, limit, verify, best)
        return [(k, *v) for k, v in sorted(best.items())]

    def _verified(self, terms: np.ndarray, passage: list[str], first: int, limit: float, verify: float, best: dict) -> None:
        """Search one passage and keep each verified item's best in ``best``."""
        for item, score in self.search(terms.tolist(), limit):
            question, answer = (overlap(x, passage) for x in self.parts[item])
            if question >= verify and answer >= verify and (item not in best or score > best[item][0] + 1e-12):
                best[item] = (score, question, answer, first)


def _passes(benchmark: DataFrame, max_items: int) -> Iterator:
    """Broadcast parts of the indexes, each over at most about ``max_items`` items."""
    items = small_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    spark, parts = benchmark.sparkSession, max(1, -(-items.count() // max_items))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for (t,) in rows_of(batch.select(["text"]))]
            words = [w for w in words if w]
            found = Counter(t for w in words for t in set(w))
            # the empty word stands for the number of items, and a blank for their length
            found[""], found[" "] = len(words), sum(map(len, words))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    counts = items.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    whole = {r.word: r.n for r in counts.where("word in ('', ' ')").collect()}
    n = whole.get("", 0)
    if not n:
        return
    for k in range(parts):
        # a part's items, and the counts of its own words alone
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect() if words_of(r.text)]
        own = spark.createDataFrame([(t,) for t in sorted({t for _, text in rows for t in words_of(text)})], "word string")
        frequency = {r.word: r.n for r in counts.join(F.broadcast(own), "word").collect()}
        classes: dict[int, list] = {}
        for item in rows:
            classes.setdefault(length_class(words_of(item[1])), []).append(item)
        every = Counts(n, whole[" "] / n, frequency)
        yield spark.sparkContext.broadcast(Part([Index(own_items, size, every) for size, own_items in sorted(classes.items())]))


class Part:
    """The indexes of a pass, and the words of all of them."""

    def __init__(self, indexes: list[Index]):
        self.places = {t: k for k, t in enumerate(sorted({t for x in indexes for t in x.terms}))}
        self.indexes = [x.within(self.places) for x in indexes]

    def hits(self, text: str | None, limit: float = LIMIT, verify: float = VERIFY) -> Iterator[tuple]:
        """(item_id, score, question overlap, answer overlap, first word) of each verified item."""
        words = words_of(text)
        places = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        for index in self.indexes:
            for k, *rest in index.hits(words, places, limit, verify):
                yield index.ids[k], *rest


COLUMNS = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def find(docs: DataFrame, benchmark: DataFrame, limit: float = LIMIT, verify: float = VERIFY, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: each leaked item of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in _passes(benchmark, max_items):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc_id, item, round(score, 6), round(q, 6), round(a, 6), at) for doc_id, text in rows_of(batch) for item, score, q, a, at in part.value.hits(text, limit, verify)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], COLUMNS)

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def keep(docs: DataFrame, benchmark: DataFrame, limit: float = LIMIT, verify: float = VERIFY, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index("text")
    for part in _passes(benchmark, max_items):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaked = [any(True for _ in part.value.hits(x[0], limit, verify)) for x in rows_of(batch.select([at]))]
                yield batch.filter(pa.array([not x for x in leaked], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
