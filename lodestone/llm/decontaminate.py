"""Benchmark decontamination: a BM25 index of test items, asked by every training passage.

A document is read as overlapping windows of twice the longest item, each starting one
longest item after the last, so every place an item could stand lies whole in some
window. The index holds the test items: for each word a posting list of items with
BM25 impacts divided by the item's score for its own text. A window that has all words
of an item scores 1 for it. Items lie in blocks, and for each word and block the
highest impact is known; the sums of those maxima over a window's distinct words are
taken for all windows of a batch together, and a block whose sum stays below
`retrieve` is passed over. In the blocks that are left, WAND steps from pivot to pivot
and returns all items that reach `retrieve`.

A retrieved item is then verified. It is split into question and answer (after an
"answer:" mark, else at its last sentence, else at two thirds of its words), and the
shares of their five-word runs that the window has must reach `question` and `answer`.

Repeated rows of the benchmark are one item with a count. A benchmark of up to `block_bytes`
is one index. A larger one is cut into blocks of about half of that, by a hash of id and
text; a task builds the index of each block, and the driver hands them on one by one as
broadcasts, which lie on disk. One pass over the documents asks all of them: a worker keeps
the first `INDEXES` open and reads the others again for each `ROWS` documents, so what the
driver and a worker hold is bounded whatever the size of the benchmark. Document
frequencies, mean length and window size are those of all items, so scores do not depend
on which items share a block.

Defined results: null texts and items without words match nothing; an item of fewer than
five words is matched where all its words stand in a row; of several windows of a document that
match an item, the best score and the first such window are reported; repeated rows
are reported each; of items of equal id each is matched on its own.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cluster import ship
from lodestone.llm.common import cut, give_back, map_batches

K1, B = 1.2, 0.75
RUN = 5
#: Items of a block at least, and blocks at most.
BLOCK, BLOCKS = 4, 64
#: Indexes a worker keeps open, some 15 MB packed and several times that open, and documents it takes at a time where there are more.
INDEXES, ROWS = 2, 2048
#: Bytes an item counts for beside its text.
ITEM = 64
_TO_SPACE = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words between ASCII signs and white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    whole = words_of(text)
    if len(whole) < RUN:
        return whole, []
    marked = re.search(r"(?is)^(.*\S)\s*\banswer\s*:\s*(\S.*)$", text)
    if marked:
        return words_of(marked[1]), words_of(marked[2])
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) > 1:
        answer = words_of(sentences[-1])
        return words_of(" ".join(sentences[:-1])), answer
    split = len(whole) * 2 // 3
    return whole[:split], whole[split:]


def runs(words: list[bytes]) -> set[bytes]:
    """All runs of five words; of fewer words the whole."""
    if len(words) < RUN:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + RUN]) for i in range(len(words) - RUN + 1)}


@dataclass
class Statistics:
    items: int
    words: int
    longest: int
    frequency: dict[bytes, int]  # word -> items with it


class Index:
    """Postings of the items, blocks with maxima, and the parts to verify."""

    def __init__(self, items: list[tuple[int, str]], copies: list[int] | None = None, over_all: Statistics | None = None):
        """`copies` says how many rows each item stands for; `over_all` are statistics of more items than these."""
        every = [(i, t, words_of(t), c) for (i, t), c in zip(items, copies or [1] * len(items), strict=True)]
        every = [x for x in every if x[2]]
        read = [x[:3] for x in every]
        self.copies = [x[3] for x in every]
        self.ids = [i for i, _, _ in read]
        self.parts = [tuple(map(runs, question_and_answer(t))) for _, t, _ in read]
        self.lengths = [tuple(min(len(p), RUN) for p in question_and_answer(t)) for _, t, _ in read]
        if over_all is None:
            frequency = Counter()
            for _, _, w, c in every:
                for word in set(w):
                    frequency[word] += c
            words = sum(len(w) * c for _, _, w, c in every)
            over_all = Statistics(sum(self.copies), words, max((len(w) for _, _, w in read), default=0), frequency)
        self.longest, frequency = over_all.longest, over_all.frequency
        n, mean = over_all.items, over_all.words / max(1, over_all.items)
        idf = {word: math.log(1 + (n - df + 0.5) / (df + 0.5)) for word, df in frequency.items()}
        lists: dict[bytes, list[tuple[int, float]]] = {word: [] for word in idf}
        for d, (_, _, w) in enumerate(read):
            raw = {
                word: idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for word, tf in Counter(w).items()
            }
            own = sum(raw.values())
            for word, impact in raw.items():
                lists[word].append((d, impact / own))
        self.term = {word: t for t, word in enumerate(lists)}
        self.postings = [[d for d, _ in p] for p in lists.values()]
        self.impacts = [[x for _, x in p] for p in lists.values()]
        self.block = max(BLOCK, -(-len(read) // BLOCKS))
        self.bounds = np.zeros((len(lists), -(-len(read) // self.block)), dtype=np.float32)
        for t, (p, x) in enumerate(zip(self.postings, self.impacts, strict=True)):
            np.maximum.at(self.bounds[t], np.array(p) // self.block, np.array(x, dtype=np.float32))

    def retrieve(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """All (item, score) of a block with score >= `least`, by WAND with the block's maxima."""
        first, end = block * self.block, min((block + 1) * self.block, len(self.ids))
        cursors = []
        for t in terms:
            top = float(self.bounds[t, block])
            if top > 0:
                p = self.postings[t]
                k = bisect_left(p, first)
                cursors.append([p[k], k, top, p, self.impacts[t]])
        found = []
        least -= 1e-6
        while True:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] >= end:
                    break
                total += c[2]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(c[4][c[1]] for c in cursors if c[0] == item)
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors:
                if c[0] >= target:
                    break
                c[1] = bisect_left(c[3], target, c[1])
                c[0] = c[3][c[1]] if c[1] < len(c[3]) else end

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's runs that stand in `words`; 1 for a part without words."""
        shares = []
        for part, length in zip(self.parts[item], self.lengths[item], strict=True):
            here = {b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)} if part else set()
            shares.append(len(part & here) / len(part) if part else 1.0)
        return shares[0], shares[1]

    def matches(self, texts: list[str], least: float, question: float, answer: float) -> list[tuple[int, int, float, int, float, float]]:
        """(text, item, score, first word of the window, question share, answer share) of each verified item."""
        if not self.ids:
            return []
        stride, find, n_terms = self.longest, self.term.get, len(self.term)
        all_words, keys, owner, begin = [], [], [], []
        for k, text in enumerate(texts):
            words = words_of(text)
            all_words.append(words)
            if not words:
                continue
            n = max(1, -(-(len(words) - stride) // stride))
            terms = np.fromiter(map(find, words, repeat(-1)), dtype=np.int64, count=len(words))
            at = np.flatnonzero(terms >= 0)
            terms, chunk = terms[at], at // stride
            base = len(owner)
            for window in (chunk, chunk - 1):  # a word stands in the window that starts at its stretch and the one before
                ok = (window >= 0) & (window < n)
                keys.append((base + window[ok]) * n_terms + terms[ok])
            owner.extend([k] * n)
            begin.extend(range(0, n * stride, stride))
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        if not len(keys):
            return []
        window, term = np.divmod(keys, n_terms)
        best: dict[tuple[int, int], tuple[int, int, float, int, float, float]] = {}
        for some in range(0, len(keys), 1 << 18):  # in slices, so that the table of bounds stays small
            lo = int(np.searchsorted(window, window[some])) if some else 0
            hi = min(some + (1 << 18), len(keys))
            hi = int(np.searchsorted(window, window[hi])) if hi < len(keys) else hi
            if lo >= hi:
                continue
            starts = np.flatnonzero(np.r_[True, window[lo + 1 : hi] != window[lo : hi - 1]])
            sums = np.add.reduceat(self.bounds[term[lo:hi]], starts, axis=0)
            stops = np.append(starts[1:], hi - lo)
            for i, block in np.argwhere(sums >= least - 1e-4).tolist():
                w = int(window[lo + starts[i]])
                k, first = owner[w], begin[w]
                passage = all_words[k][first : first + 2 * stride]
                for item, score in self.retrieve(term[lo + starts[i] : lo + stops[i]].tolist(), block, least):
                    if (k, item) in best and best[k, item][2] >= score:
                        continue
                    q, a = self.verify(item, passage)
                    if q >= question and a >= answer:
                        best[k, item] = (k, item, score, first, q, a)
        return sorted(best.values())


def _indexes(items: DataFrame, key: str, text: str, block_bytes: int) -> list[Broadcast]:
    """Broadcasts of the packed indexes of the distinct items with words; where there are several, all score by the statistics of all items."""
    context = items.sparkSession.sparkContext
    spoken = items.filter(F.col(text).rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"))
    every = spoken.groupBy(F.col(key).alias("_k"), F.col(text).alias("_t")).agg(F.count("*").alias("_c"))
    size = every.agg(F.coalesce(F.sum(F.octet_length("_t") + ITEM), F.lit(0))).first()[0]
    if size <= block_bytes:
        rows = every.collect()
        return [context.broadcast(pickle.dumps(Index([(r._k, r._t) for r in rows], [r._c for r in rows])))]
    built = _built(every, -(-2 * size // block_bytes))
    # one at a time: the driver keeps none, a broadcast's bytes lie in a file
    return [context.broadcast(bytes(r.packed)) for r in built.toLocalIterator()]


def _built(every: DataFrame, n: int) -> DataFrame:
    """(packed): the indexes of `n` blocks of the items (_k, _t, _c), each built in a task."""
    every = cut(every.withColumn("_b", F.pmod(F.xxhash64("_k", "_t"), F.lit(n)).cast("int")))

    def read(batch: pa.RecordBatch) -> dict[str, object]:
        words = [words_of(t) for t in batch.column(0).to_pylist()]
        return {
            "_c": batch.column(1), "_b": batch.column(2), "n": [len(w) for w in words],
            "words": pa.array([sorted(set(w)) for w in words], type=pa.list_(pa.binary())),
        }

    counted = cut(map_batches(every.select("_t", "_c", "_b"), "_c bigint, _b int, n bigint, words array<binary>", read))
    total = counted.agg(F.sum("_c").alias("items"), F.sum(F.col("n") * F.col("_c")).alias("words"), F.max("n").alias("longest")).first()
    # a word is one row for each block, so a common one meets n rows at most
    here = counted.select("_b", "_c", F.explode("words").alias("word")).groupBy("_b", "word").agg(F.sum("_c").alias("c"))
    here = cut(here)
    frequency = here.groupBy("word").agg(F.sum("c").alias("df"))
    here = here.select("_b", "word").join(frequency, "word")
    items, words, longest = total.items, total.words, total.longest

    def build(block: pa.Table, spoken: pa.Table) -> pa.Table:
        over_all = Statistics(items, words, longest, dict(zip(spoken["word"].to_pylist(), spoken["df"].to_pylist(), strict=True)))
        rows = sorted(zip(*(block[c].to_pylist() for c in ("_k", "_t", "_c")), strict=True), key=repr)
        index = Index([(k, t) for k, t, _ in rows], [c for _, _, c in rows], over_all)
        return pa.table({"packed": pa.array([pickle.dumps(index)], type=pa.binary())})

    return cut(every.groupBy("_b").cogroup(here.groupBy("_b")).applyInArrow(build, "packed binary"))


class _Open:
    """The indexes of a task: the first are kept, the others read when they are asked for."""

    def __init__(self, shared: list[Broadcast]):
        self.shared, self.kept = shared, {}
        self.rows = 512 if len(shared) <= INDEXES else ROWS

    def __iter__(self) -> Iterator[Index]:
        for k, one in enumerate(self.shared):
            index = self.kept.get(k)
            if index is None:
                # `value` would keep every index for as long as the worker lives
                path = getattr(one, "_path", None)
                index = pickle.loads(one.load_from_path(path) if path else one.value)
                if k < INDEXES:
                    self.kept[k] = index
            yield index


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    retrieve: float = 0.6,
    question: float = 0.8,
    answer: float = 0.8,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """(key, item_key, score, first_word, question_overlap, answer_overlap) of each document and item that match."""
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = (
        f"{key} {kinds[0]}, {item_key} {kinds[1]}, score double, first_word bigint, "
        "question_overlap double, answer_overlap double"
    )
    ship(documents.sparkSession)
    indexes = _Open(_indexes(items, item_key, item_text, block_bytes))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        which, ids, found = [], [], []
        for index in indexes:
            for m in index.matches(texts, retrieve, question, answer):
                for _ in range(index.copies[m[1]]):
                    which.append(m[0])
                    ids.append(index.ids[m[1]])
                    found.append(m[2:])
        score, start, q, a = zip(*found, strict=True) if found else ((),) * 4
        return {
            key: batch.column(0).take(pa.array(which, type=pa.int64())), item_key: ids,
            "score": score, "first_word": start, "question_overlap": q, "answer_overlap": a,
        }

    return map_batches(documents.select(key, text), schema, rows, indexes.rows)


def decontaminate(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    retrieve: float = 0.6,
    question: float = 0.8,
    answer: float = 0.8,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """The rows of `documents` that match no item, all columns as they are; nothing is shuffled."""
    ship(documents.sparkSession)
    place = documents.columns.index(text)
    indexes = _Open(_indexes(items, item_key, item_text, block_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, indexes.rows):
                part = batch.slice(at, indexes.rows)
                for index in indexes:
                    texts = [t or "" for t in part.column(place).to_pylist()]
                    bad = {m[0] for m in index.matches(texts, retrieve, question, answer)}
                    part = part.filter(pa.array([k not in bad for k in range(len(texts))], type=pa.bool_()))
                yield part
        give_back()

    return documents.mapInArrow(run, documents.schema)
