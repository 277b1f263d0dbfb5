"""Removal of passages that stand earlier: every byte that a repeated string of `length` bytes covers.

A window is a string of `length` bytes. Not every window can be shuffled, so windows meet
where they are sure to agree: each window names its smallest gram of `gram` bytes by a hash,
the leftmost of equal ones, and neighbouring windows mostly name the same gram, an anchor.
Equal windows have the same anchor content at the same place, and all windows of an anchor
lie in its context, `length - gram` bytes before it and `length` from it on.

1. Every anchor is one row: hash of its gram, hash of its context, document, place and
   windows. Anchors whose context stands earlier are repeated with all their windows. An
   anchor whose gram occurs in one context only has no other repeats and is dropped; most
   are. Rows of a task that agree become one before the shuffle, and grams that a task has
   met in several contexts travel by gram and context, so a common passage is no hot key.
2. What is left are anchors whose gram has several contexts, at the edges of repeated
   passages. Their contexts are fetched, and of each gram the suffixes that begin at the
   anchors are sorted by a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes; so are the reversed texts
   before the anchors. Common extensions of neighbours are verified byte by byte, and where
   a hash has misled the sort, bytes decide. A window with o bytes before its anchor is
   equal to another where the common extensions are o at least on the left and
   `length - o` on the right: two intervals of the sorted suffixes.
3. Of grams in more than `hot_limit` contexts each window travels by two hashes of its own
   bytes instead, again one row for a window of a task.
4. Repeated windows go back to their documents, which lose the bytes they cover.

Whole contexts and windows of hot grams are told apart by 128 bits of two hashes; all other
matches are verified by bytes. Documents are read in pieces of a megabyte, so a very long
one needs no more memory than its text.

Defined results: a null text is the empty one. Earlier means a smaller id, then an earlier
start. Null ids come last; rows of equal or null ids are told apart by their texts, in the
order of a hash, and rows that agree in both are one document, each with its result.
Documents shorter than `length` stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.llm.buckets import map_groups
from lodestone.llm.common import cut, give_back, map_batches, text_or_empty

PIECE_BITS = 20
PLAIN, OPEN, TOKEN, REPEATED = range(4)


class Hashes:
    """Prefix polynomial hashes modulo 2 ** 64 over a table of random byte values; a base that is odd can be divided by."""

    def __init__(self, seed: int):
        rng = np.random.default_rng([13, seed])
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 3
        self.last = np.uint64(int(rng.integers(0, 1 << 62)) * 2 + 1)
        self.powers = self.back = np.ones(1, dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """[n + 1]: the hash of the first i bytes is at i."""
        if len(data) >= len(self.powers):
            size = len(data) + 1
            inverse = pow(self.base, -1, 1 << 64)
            for name, base in (("powers", self.base), ("back", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end, the same wherever they stand."""
        return (prefixes[end] - prefixes[start]) * self.back[start]

    def mixed(self, x: np.ndarray) -> np.ndarray:
        """Every bit depends on all bits."""
        x = (x ^ (x >> np.uint64(32))) * self.last
        x = (x ^ (x >> np.uint64(29))) * self.last
        return x ^ (x >> np.uint64(32))


_ONE, _TWO = Hashes(1), Hashes(2)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, context hash, place, lowest and highest window) of all anchors of texts data[starts:ends].

    Of each text the windows from `first` to before `last` count; all numbers are places in
    `data`, which has at most 2 ** PIECE_BITS bytes.
    """
    count = np.maximum(last - first, 0)
    text = np.repeat(np.arange(len(starts)), count)
    if not len(text):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    windows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    one, two = _ONE.prefixes(data), _TWO.prefixes(data)
    grams = _ONE.mixed((one[gram:] - one[:-gram]) * _ONE.back[: len(one) - gram])
    # the lowest bits hold the place, so that the smallest value is the leftmost of the smallest grams
    least = (grams >> np.uint64(PIECE_BITS)) << np.uint64(PIECE_BITS) | np.arange(len(grams), dtype=np.uint64)
    span, reach = length - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least[windows] & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)
    begins = np.r_[True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1) | (text[1:] != text[:-1])]
    at = np.flatnonzero(begins)
    low, high = windows[at], windows[np.append(at[1:], len(windows)) - 1]
    text, place = text[at], place[at]
    before, after = np.maximum(place - (length - gram), starts[text]), np.minimum(place + length, ends[text])
    shape = (place - before).astype(np.uint64) * np.uint64(2 * length) + (after - place).astype(np.uint64)
    context = _TWO.mixed(_TWO.of(two, before, after) + _TWO.mixed(shape))
    return text, grams[place], context, place, low, high


def pieces(offsets: np.ndarray, length: int, gram: int, most: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (document, start, end, first window, window behind the last), together at most `most` bytes.

    Long documents are cut; a piece reaches as far to both sides as the contexts of its windows.
    """
    group: list[tuple[int, int, int, int, int]] = []
    held, step = 0, most - 4 * length
    for doc, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for low in range(a, z - length + 1, step):
            high = min(low + step, z - length + 1)
            start, end = max(a, low - (length - gram)), min(z, high + 2 * length)
            if held + end - start > most:
                yield group
                group, held = [], 0
            group.append((doc, start, end, low, high))
            held += end - start
    if group:
        yield group


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _before(columns: list[np.ndarray], of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether rows of sorted columns come after the first row of their class."""
    late = np.zeros(len(of), dtype=bool)
    for c in columns:
        late |= c != c[first[of]]
    return late


def _classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, first row of each class) of sorted keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def merged(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (document, text and place of the first, number) with those that touch made one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], windows[order]
    of, _ = _classes([doc, at >> 32])
    start = (at & 0x7FFFFFFF) + (of << 32)  # one line of places, each text behind the one before
    reach = np.maximum.accumulate(start + n)
    begin = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]][: len(doc)])
    stop = np.append(begin[1:], len(doc))[: len(begin)] - 1
    return doc[begin], at[begin], reach[stop] - start[begin]


ROW = "key bigint, h bigint, f bigint, doc bigint, at bigint, span int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _combined(h: np.ndarray, f: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Rows of one task: what stands earlier in it is settled, the rest travels by gram, or by gram and context where the gram has several here."""
    order = np.lexsort((at, doc, f, h))
    h, f, doc, at, low, high = (x[order] for x in (h, f, doc, at, low, high))
    of, first = _classes([h, f])
    late = _before([doc, at], of, first)
    gram, gram_first = _classes([h])
    contexts = np.bincount(gram[first], minlength=len(gram_first))
    several = contexts[gram] > 1
    marks = merged(doc[late], at[late] - high[late], (high - low + 1)[late])
    plain, open_ = ~late & ~several, ~late & several
    tokens = h[gram_first[contexts > 1]]
    none = lambda n: np.zeros(n, dtype=np.int64)
    mixed = lambda a, b: _signed(_ONE.mixed(a.view(np.uint64) * np.uint64(3) + b.view(np.uint64)))
    span = (low << 16 | high << 2).astype(np.int64)
    parts = [
        (h[plain], none(plain.sum()), f[plain], doc[plain], at[plain], span[plain] | PLAIN),
        (mixed(h[open_], f[open_]), h[open_], f[open_], doc[open_], at[open_], span[open_] | OPEN),
        (tokens, none(len(tokens)), none(len(tokens)), none(len(tokens)), none(len(tokens)), none(len(tokens)) | TOKEN),
        (mixed(marks[0], marks[1]), none(len(marks[0])), none(len(marks[0])), marks[0], marks[1], marks[2] << 2 | REPEATED),
    ]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    kinds = _names(ROW)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n == "span" else c) for n, c in zip(kinds, columns, strict=True)], names=kinds)


def anchor_rows(docs: DataFrame, length: int, gram: int, flush: int = 400_000) -> DataFrame:
    """ROWs of the anchors of `docs` (doc, tie, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            name, tie, texts = (batch.column(i) for i in range(3))
            name, tie = name.to_numpy(), tie.to_numpy().astype(np.int64) << 32
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if offsets[-1] else np.zeros(0, dtype=np.uint8)
            for group in pieces(offsets, length, gram, 1 << PIECE_BITS):
                of, start, end, low, high = np.array(group, dtype=np.int64).T
                size = end - start
                begin = np.cumsum(size) - size
                shift = begin - start  # from places in the batch to places in the piece
                chunk = np.concatenate([data[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)])
                text, h, f, place, first, last = anchors(chunk, begin, begin + size, low + shift, high + shift, length, gram)
                at = tie[of[text]] + place - shift[text] - offsets[of[text]]
                held.append((_signed(h), _signed(f), name[of[text]], at, place - last, place - first))
                rows += len(text)
                if rows >= flush:
                    yield _combined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, rows = [], 0
        if rows:
            yield _combined(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held = []
        give_back()

    return docs.select("doc", "tie", "text").mapInArrow(run, ROW)


FOUND = "repeated boolean, h bigint, doc bigint, at bigint, span int"


def _found(repeated: tuple[np.ndarray, ...], left: tuple[np.ndarray, ...]) -> list[pa.RecordBatch]:
    """A batch of FOUND: repeated windows (doc, at, number), and anchors (h, doc, at, span) that are left."""
    n, m = len(repeated[0]), len(left[0])
    columns = [np.repeat([True, False], [n, m]), np.concatenate([np.zeros(n, dtype=np.int64), left[0]])]
    columns += [np.concatenate([a, b]) for a, b in zip(repeated, left[1:], strict=True)]
    names = _names(FOUND)
    return [pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k == "span" else c) for k, c in zip(names, columns, strict=True)], names=names)]


def _settle(table: pa.Table, _starts: np.ndarray) -> list[pa.RecordBatch]:
    """Of rows by gram: contexts that stand earlier are repeated; grams of several contexts are left."""
    key, h, f, doc, at, span = (table.column(c).to_numpy() for c in ("key", "h", "f", "doc", "at", "span"))
    kind, span = span & 3, span.astype(np.int64)
    done = kind == REPEATED
    repeated, left = [(doc[done], at[done], span[done] >> 2)], []
    tokens = np.unique(key[kind == TOKEN])
    for k in (PLAIN, OPEN):
        rows = np.flatnonzero(kind == k)
        rows = rows[np.lexsort((at[rows], doc[rows], f[rows], key[rows]))]
        if not len(rows):
            continue
        of, first = _classes([key[rows], f[rows]])
        late = _before([doc[rows], at[rows]], of, first)
        low, high = span[rows] >> 16, span[rows] >> 2 & 0x3FFF
        repeated.append((doc[rows][late], (at[rows] - high)[late], (high - low + 1)[late]))
        keep = ~late
        if k == PLAIN:
            gram, begin = _classes([key[rows]])
            several = np.bincount(gram[first], minlength=len(begin)) > 1
            keep &= several[gram] | np.isin(key[rows], tokens)
        name = (key if k == PLAIN else h)[rows]
        left.append((name[keep], doc[rows][keep], at[rows][keep], span[rows][keep]))
    nothing = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    join = lambda parts: tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    return _found(join(repeated), join([nothing, *left]))


class Suffixes:
    """Texts to be sorted inside groups, compared by prefix hashes of all their bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: Hashes | None = None):
        self.data, self.start, self.size = data, start, size
        self.hashes = hashes or _ONE
        self.prefixes = self.hashes.prefixes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the texts a and b begin with in common, by their hashes: a binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.size[a], self.size[b])
        x, y = self.start[a], self.start[b]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes.of(self.prefixes, x, x + middle) == self.hashes.of(self.prefixes, y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = self.common(a, b)
        x, y = self.size[a] > shared, self.size[b] > shared
        out = ~x & y
        both = np.flatnonzero(x & y)
        out[both] = self.data[self.start[a[both]] + shared[both]] < self.data[self.start[b[both]] + shared[both]]
        return out

    def order(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the texts sorted inside their groups, which stand together from `begin` to `end` of each text.

        A mergesort from below, all runs of a width at once: the place of a text is its place
        in its own run and the number of texts before it in the other, found by binary search.
        """
        out, width = np.arange(len(begin)), 1
        longest = int((end - begin).max(initial=0))
        while width < longest:
            slot = np.arange(len(out))
            left = begin + (slot - begin) // (2 * width) * (2 * width)
            middle = np.minimum(left + width, end)
            slot = slot[middle < np.minimum(left + 2 * width, end)]
            left, middle = left[slot], middle[slot]
            stop = np.minimum(left + 2 * width, end[slot])
            own = slot < middle
            low, high = np.where(own, middle, left), np.where(own, stop, middle)
            while len(open_ := np.flatnonzero(low < high)):
                at = (low[open_] + high[open_]) >> 1
                mine, other = out[slot[open_]], out[at]
                # from the left run: those less than mine; from the right run: those not above mine
                first = np.where(own[open_], other, mine)
                goes = self.less(first, np.where(own[open_], mine, other)) == own[open_]
                low[open_] = np.where(goes, at + 1, low[open_])
                high[open_] = np.where(goes, high[open_], at)
            new = out.copy()
            new[slot + low - middle] = out[slot]
            out, width = new, 2 * width
        return out

    def verified(self, order: np.ndarray, group: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(order, how many bytes each text has in common with the one before it), by bytes; -1 begins a group.

        Where bytes contradict the order, a hash has misled it, and bytes sort the texts anew.
        """
        shared = np.full(len(order), -1, dtype=np.int64)
        width = int(self.size.max(initial=0))
        padded = np.concatenate([self.data, np.zeros(width + 1, dtype=np.uint8)])
        pairs = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        columns = np.arange(width + 1, dtype=np.int64)
        for some in range(0, len(pairs), block):
            i = pairs[some : some + block]
            a, b = order[i - 1], order[i]
            least = np.minimum(self.size[a], self.size[b])
            differ = padded[self.start[a][:, None] + columns] != padded[self.start[b][:, None] + columns]
            differ |= columns >= least[:, None]
            n = differ.argmax(axis=1)
            rises = np.where(n < least, padded[self.start[a] + n] < padded[self.start[b] + n], self.size[a] <= self.size[b])
            if not rises.all():
                key = lambda t: (group[t], self.data[self.start[t] : self.start[t] + self.size[t]].tobytes())
                return self.verified(np.array(sorted(range(len(order)), key=key), dtype=np.int64), group, block)
            shared[i] = n
        return order, shared


def repeated_windows(group: np.ndarray, rank: np.ndarray, contexts: list[bytes], before: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """[rows, o]: whether the window with o bytes before the anchor stands in a row of the group with a lower `rank`.

    Rows of a group stand together; `before` bytes of each context come before its anchor,
    and windows from `low` to `high` bytes before it are asked for.
    """
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    start = np.cumsum(size) - size
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.append(begins, len(group)))
    begin, end = np.repeat(begins, counts), np.repeat(begins + counts, counts)
    backwards = np.ascontiguousarray(data[::-1])
    right = Suffixes(data, start + before, np.minimum(size - before, length))
    left = Suffixes(backwards, len(data) - start - before, before)
    classes = []
    for side in (right, left):
        order, shared = side.verified(side.order(begin, end), group)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        classes.append((place, shared))
    by_rank = np.argsort(rank, kind="stable")
    out = np.zeros((len(group), int(high.max(initial=0)) + 1), dtype=bool)
    for o in range(out.shape[1]):
        asked = by_rank[(low[by_rank] <= o) & (o <= high[by_rank])]
        if len(asked) < 2:
            continue
        # a class is a run of sorted suffixes with so much in common
        of = [np.cumsum(shared < least)[place[asked]] for (place, shared), least in zip(classes, (length - o, o), strict=True)]
        key = of[0] * (len(group) + 1) + of[1]
        _, first, name = np.unique(key, return_index=True, return_inverse=True)
        out[asked, o] = rank[asked] > rank[asked[first[name]]]
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first and last column) of the runs of true values."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _ranks(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in the order of document and place, equal for equal ones."""
    order = np.lexsort((at, doc))
    of, _ = _classes([doc[order], at[order]])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = of
    return out


CONTEXT = "key bigint, f bigint, doc bigint, at bigint, span int, before int, context binary"


def _contexts(docs: DataFrame, left: DataFrame, length: int, gram: int) -> DataFrame:
    """CONTEXT rows of the anchors that are left, and one row for each window of hot grams (without a context)."""
    lists = left.groupBy("doc", (F.col("at").bitwiseAND(0x7FFFFFFF00000000)).alias("tie")).agg(F.collect_list(F.struct("h", "at", "span", "hot")).alias("anchors"))
    texts = docs.select("doc", F.shiftleft(F.col("tie").cast("long"), 32).alias("tie"), "text").filter(F.octet_length("text") >= length)
    joined = texts.join(lists.hint("shuffle_hash"), ["doc", "tie"]).select("doc", "text", "anchors")

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        lists = batch.column(2)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        of = np.repeat(np.arange(len(counts)), counts)
        h, at, span, hot = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("h", "at", "span", "hot"))
        doc = batch.column(0).to_numpy()[of]
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        place, low, high = at & 0x7FFFFFFF, span.astype(np.int64) >> 16, span.astype(np.int64) >> 2 & 0x3FFF
        before = np.minimum(place, length - gram)
        found = [texts[i][p - b : p + length] for i, p, b in zip(of.tolist(), place.tolist(), before.tolist(), strict=True)]
        cold = np.flatnonzero(~hot)
        out = [h[cold], np.zeros(len(cold), dtype=np.int64), doc[cold], at[cold], span[cold], before[cold]]
        warm = np.flatnonzero(hot)
        texts = []
        if len(warm):
            data = np.frombuffer(b"".join(found[i] for i in warm), dtype=np.uint8)
            sizes = np.array([len(found[i]) for i in warm], dtype=np.int64)
            anchor = np.cumsum(sizes) - sizes + before[warm]
            n = high[warm] - low[warm] + 1
            row = np.repeat(np.arange(len(warm)), n)
            o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[warm][row]
            start = anchor[row] - o
            w1, w2 = (_signed(x.mixed(x.of(x.prefixes(data), start, start + length))) for x in (_ONE, _TWO))
            d, a = doc[warm][row], at[warm][row] - o
            order = np.lexsort((a, d, w2, w1))
            w1, w2, d, a = w1[order], w2[order], d[order], a[order]
            same, first = _classes([w1, w2])
            late = _before([d, a], same, first)
            marks = merged(d[late], a[late], np.ones(late.sum(), dtype=np.int64))
            again = _signed(_ONE.mixed(marks[0].view(np.uint64) * np.uint64(3) + marks[1].view(np.uint64)))
            zero = lambda k: np.zeros(k, dtype=np.int64)
            windows = [w1[~late], w2[~late], d[~late], a[~late], zero((~late).sum()) | PLAIN, zero((~late).sum())]
            done = [again, zero(len(again)), marks[0], marks[1], marks[2] << 2 | REPEATED, zero(len(again))]
            out = [np.concatenate(c) for c in zip(out, windows, done, strict=True)]
        kept = pa.array([found[i] for i in cold.tolist()] + [None] * (len(out[0]) - len(cold)), type=pa.binary())
        return {**dict(zip(_names(CONTEXT), out, strict=False)), "context": kept}

    return map_batches(joined, CONTEXT, rows, rows=256)


def _compared(length: int):
    """Work on groups of CONTEXT rows: the windows that stand earlier."""

    def work(table: pa.Table, _starts: np.ndarray) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        key, f, doc, at, span, before = (table.column(c).to_numpy() for c in ("key", "f", "doc", "at", "span", "before"))
        has = table.column("context").is_valid().to_numpy()
        span = span.astype(np.int64)
        done = ~has & (span & 3 == REPEATED)
        repeated = [(doc[done], at[done], span[done] >> 2)]
        rows = np.flatnonzero(~has & ~done)
        rows = rows[np.lexsort((at[rows], doc[rows], f[rows], key[rows]))]
        if len(rows):
            of, first = _classes([key[rows], f[rows]])
            late = rows[_before([doc[rows], at[rows]], of, first)]
            repeated.append((doc[late], at[late], np.ones(len(late), dtype=np.int64)))
        rows = np.flatnonzero(has)
        if len(rows):
            contexts = table.column("context").combine_chunks().take(pa.array(rows)).to_pylist()
            d, a, low, high = doc[rows], at[rows], span[rows] >> 16, span[rows] >> 2 & 0x3FFF
            marks = repeated_windows(key[rows], _ranks(d, a), contexts, before[rows].astype(np.int64), low, high, length)
            row, first, last = _runs(marks)
            repeated.append((d[row], a[row] - last, last - first + 1))
        nothing = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        parts = tuple(np.concatenate(c) for c in zip(*repeated, strict=True))
        return _found(merged(*parts), nothing)

    return work


def _kept(batch: pa.RecordBatch, key: str, length: int) -> dict[str, object]:
    lists = batch.column(2)
    out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    places, runs = lists.offsets.to_numpy(), lists.values  # a null list is an empty one
    first, n = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
    for i, text in enumerate(batch.column(1)):
        data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
        start, end = first[places[i] : places[i + 1]].astype(np.int64), n[places[i] : places[i + 1]].astype(np.int64)
        removed = spans = 0
        digest = hashlib.sha256()
        at = 0
        if len(start):
            order = np.argsort(start, kind="stable")
            start = start[order]
            end = np.maximum.accumulate(start + end[order] - 1 + length)
            new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            low, high = start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist()
            spans = len(low)
            for a, z in zip(low, high, strict=True):
                digest.update(data.slice(at, a - at))
                removed += z - a
                at = z
        digest.update(data.slice(at))
        for c, v in zip(out, (data.size, removed, spans, digest.hexdigest()), strict=True):
            out[c].append(v)
    return {key: batch.column(0), **out}


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, hot_limit: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(documents (_id, doc, tie, text), runs of repeated windows (doc, tie, first, n)); a window begins at a byte from 0."""
    if not 0 < gram < length < 8192:
        raise ValueError("a gram is shorter than a window, and a window than 8,192 bytes")
    whole = df.select(F.col(key).alias("_id"), text_or_empty(text).alias("text"))
    last = F.lit(2**63 - 1)
    docs = whole.select("_id", F.coalesce(F.col("_id").cast("long"), last).alias("doc"), F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int").alias("tie"), "text")
    rows = anchor_rows(docs.filter(F.octet_length("text") >= length), length, gram)
    found = cut(map_groups(rows, ["key"], StructType.fromDDL(FOUND), _settle, at_once=150_000))
    left = found.filter("NOT repeated").select("h", "doc", "at", "span")
    hot = cut(left.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot_limit).select("h", F.lit(True).alias("hot")))
    left = left.withColumn("hot", F.lit(False)) if hot.isEmpty() else left.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    near = cut(map_groups(_contexts(docs, left, length, gram), ["key"], StructType.fromDDL(FOUND), _compared(length), at_once=20_000))
    runs = found.filter("repeated").unionByName(near).select("doc", F.shiftright("at", 32).cast("int").alias("tie"), F.col("at").bitwiseAND(0x7FFFFFFF).cast("int").alias("first"), F.col("span").alias("n"))
    return docs, runs


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, hot_limit: int = 2_000) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of `df`."""
    docs, runs = repeats(df, key, text, length, gram, hot_limit)
    lists = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = docs.join(lists.hint("shuffle_hash"), ["doc", "tie"], "left").select("_id", "text", "runs")
    kind = df.schema[key].dataType.simpleString()
    return map_batches(joined, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", lambda b: _kept(b, key, length))
