"""Byte-level BPE encoding and decoding.

A rank file maps byte strings to ids; BPE merges the adjacent pair of lowest rank
until none is left. Instead of replaying the merges, a piece is encoded by
backtracking: an Aho-Corasick automaton over the vocabulary (bytes as Latin-1
characters) gives the longest token that starts at a byte; tokens are placed
from left to right, longest first, and a token may follow another only if BPE
would have kept the two apart. That question about two adjacent tokens is answered
from the merges that made them and memoised. Where no token fits, the last one is
taken back and the next shorter one tried; positions known to lead nowhere are
marked, so each is left at most once per token and the time is linear in the piece.

Defined results: a null text is the empty text, which has no ids; a null id list
decodes to empty bytes; each input row gives one output row, repeated rows
included; any further columns of the input are kept unless they are named like
an output column.
"""

from __future__ import annotations

import base64
import sys
import threading
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.llm.common import give_back, map_batches

NONE = -1


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Vocabulary:
    """The tokens of a rank file; enough to decode."""

    def __init__(self, rank_file: bytes):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in lines}

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


class Codec(Vocabulary):
    """Encoder for one rank file; pieces of up to `memo_chars` characters are remembered, at most `memo_size` of them.

    What is remembered is kept in two halves: when the newer one is full it takes the place
    of the older one, from which only pieces that were met again have been carried over.
    """

    def __init__(self, rank_file: bytes, pattern: str, memo_size: int = 200_000, memo_chars: int = 48):
        super().__init__(rank_file)
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.split_text = regex.compile(pattern).findall
        self.memo_size, self.memo_chars = memo_size, memo_chars
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """For each token the pair it was merged from, its longest proper prefix token, and the automaton.

        A token whose bytes BPE would never join from two lower ranks cannot be
        reached by merging, so it is left out of the automaton and is used only
        for a piece that equals it.
        """
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        reachable: dict[bytes, int] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                reachable[token] = rank
                continue
            for cut in range(len(token) - 1, 0, -1):
                left, right = reachable.get(token[:cut], NONE), reachable.get(token[cut:], NONE)
                if left != NONE and right != NONE and self._compatible(left, right):
                    self.parts[rank] = (left, right)
                    self.joined[left, right] = rank
                    reachable[token] = rank
                    break
        self.fits.clear()
        self.reachable = reachable
        automaton = ahocorasick.Automaton()
        for token, rank in reachable.items():
            automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next(
                (reachable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), NONE
            )
        automaton.make_automaton()
        self.automaton = automaton
        self.lengths = {rank: len(token) for token, rank in reachable.items()}
        # every state of the automaton by its letters: the longest token among their beginnings
        self.best: dict[str, int] = {}
        for token in reachable:
            for n in range(1, len(token) + 1):
                begin = token[:n]
                rank = reachable.get(begin, NONE)
                self.best[begin.decode("latin-1")] = rank if rank != NONE else self.best.get(begin[:-1].decode("latin-1"), NONE)
        self.widest = max(self.lengths.values(), default=1)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves `left` and `right` as neighbours.

        Undo the later of the two merges again and again; if a pair across the
        border would have merged before the merge just undone, the two cannot stand.
        """
        joined, parts = self.joined, self.parts
        before = 1 << 62
        while True:
            if joined.get((left, right), before) < before:
                return False
            if left > right:
                before, left = left, parts[left][1]
                if left == before:
                    before, right = right + 1, parts[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, parts[right][0]
                if right + 1 == before:
                    before, left = left, parts[left][1]
                    if left == before:
                        return True

    def _adjacent(self, left: int, right: int) -> bool:
        """`_compatible`, remembered under both ranks in one number."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= self.memo_size:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def forget(self) -> None:
        """Free what was remembered, so that a worker that is kept for other work stays small."""
        self.memo, self.older = {}, {}
        self.fits.clear()

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters, size, widest = piece.decode("latin-1"), len(piece), self.widest
        reach, best, lengths, shorter, fits = self.automaton.longest_prefix, self.best, self.lengths, self.shorter, self.fits
        open_at = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, last = 0, NONE
        window = letters[:widest]
        candidate = best.get(window[: reach(window)], NONE)
        while at < size:
            while candidate != NONE:
                end = at + lengths[candidate]
                if open_at[end]:
                    if last == NONE:
                        break
                    fit = fits.get(last << 32 | candidate)
                    if self._adjacent(last, candidate) if fit is None else fit:
                        break
                candidate = shorter[candidate]
            if candidate != NONE:
                ids.append(candidate)
                at, last = end, candidate
                window = letters[at : at + widest]
                candidate = best.get(window[: reach(window)], NONE)
            elif last == NONE:
                raise ValueError("the vocabulary cannot spell these bytes")
            else:
                open_at[at] = 0
                candidate = ids.pop()
                at -= lengths[candidate]
                candidate = shorter[candidate]
                last = ids[-1] if ids else NONE
        return ids

    def encode_packed(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        memo, older, out = self.memo, self.older, []
        for piece in self.split_text(text):
            packed = memo.get(piece)
            if packed is None:
                packed = older.get(piece)
                if packed is None:
                    packed = _packed(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= self.memo_chars:
                    if len(memo) >= self.memo_size // 2:
                        self.older, self.memo = memo, {}
                        memo, older = self.memo, self.older
                    memo[piece] = packed
            out.append(packed)
        return b"".join(out)


_codecs: dict[tuple[int, str | None], Vocabulary] = {}
_lock = threading.Lock()


def _codec(rank_file: bytes, pattern: str | None) -> Vocabulary:
    """One codec for each vocabulary in a Python worker; without a pattern, one that only decodes."""
    key = (hash(rank_file), pattern)
    with _lock:
        if key not in _codecs:
            _codecs[key] = Vocabulary(rank_file) if pattern is None else Codec(rank_file, pattern)
        return _codecs[key]


def _shared_ranks(df: DataFrame, rank_path: str):
    """The rank file as a broadcast: under 1 MB for 50,000 tokens, and refused beyond 64 MB."""
    with open(rank_path, "rb") as f:
        content = f.read()
    if len(content) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not broadcast")
    return df.sparkSession.sparkContext.broadcast(content)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids binary): the ids of each text, packed as little-endian unsigned 32-bit integers.

    With `decoded` a column of that name has the bytes that the ids stand for, looked up
    in the same pass, so that a task keeps one Python worker and not two.
    """
    ranks = _shared_ranks(df, rank_path)
    kind = df.schema[key].dataType.simpleString()
    target = StructType.fromDDL(f"`{key}` {kind}, ids binary" + ", decoded binary" * decoded)
    names = target.names
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = [codec.encode_packed(t or "") for t in part.column(1).to_pylist()]
                    columns = [ids, [codec.decode_packed(p) for p in ids]] if decoded else [ids]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=pa.binary()) for c in columns)], names=names)
        finally:
            codec.forget()
            give_back()

    return df.select(key, text).mapInArrow(run, target)


def decode(df: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` binary, the bytes that the packed `ids` stand for."""
    ranks = _shared_ranks(df, rank_path)
    kept = [c for c in df.columns if c != "decoded"]
    place = kept.index(ids)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", decoded binary"

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        codec = _codec(ranks.value, None)
        decoded = pa.array([codec.decode_packed(p or b"") for p in batch.column(place).to_pylist()], type=pa.binary())
        return {c: batch.column(i) for i, c in enumerate(kept)} | {"decoded": decoded}

    return map_batches(df.select(*kept), schema, rows)


def unpack(ids: str = "ids"):
    """Column array<long> of packed ids, for readers that want numbers."""
    n, raw = F.octet_length(F.col(ids)) / 4, F.hex(F.col(ids))

    def number(i):
        byte = [F.conv(F.substr(raw, (i * 8 + 2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("long") for k in range(4)]
        return byte[0] + byte[1] * 256 + byte[2] * 65536 + byte[3] * 16777216

    numbers = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), number)
    return F.when(n > 0, numbers).otherwise(F.array().cast("array<bigint>"))
