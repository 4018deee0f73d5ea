"""Byte-level BPE, both ways, from a public rank file.

Encoding a text: the pattern cuts it into pre-tokens; each distinct one of a batch is resolved
once. First tier: a minimal perfect hash over the whole vocabulary (hash, displace; n keys on n
places, evaluated for all new pre-tokens at once) names the only entry that a pre-token can be,
and the entry's bytes verify it. Second tier, for the rest: the pre-token's bytes as a linked
list, with a heap of the adjacent pairs by (rank, place), merged until no pair has a rank.
Decoding looks ids up in the same table.

The tables are made once on the driver from the rank file, are as large as the vocabulary, and
travel with the tasks; the corpus is only ever seen in batches.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ledgerspark.llm.common import free_name
from ledgerspark.llm.shingles import lists_of, scrambled

VOCABULARY = "byte_bpe_multi_50k"
#: Fixed value: white space, the same for all Unicode versions in use.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pre-tokens resolved together, and distinct ones remembered between two such steps; both
#: bound memory and change no result.
STEP, MEMORY = 200_000, 500_000
IDS_AT_ONCE = 1 << 24


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings, by id."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are expected to be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Keys 0..n-1 on n places without a collision: a place per key, two small tables."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        hashes = self.hashes(keys)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two vocabulary entries share a hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.seed = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            members = order[starts[b] : starts[b] + sizes[b]]
            self.seed[b], places = self._displace(hashes[members])
            self.key_at[places] = members
        # a key alone in its bucket takes a free place, written down as -1 - place
        alone = by_size[sizes[by_size] == 1]
        free = np.flatnonzero(self.key_at < 0)[: len(alone)]
        self.seed[alone] = -1 - free
        self.key_at[free] = order[starts[alone]]

    def _displace(self, hashes: np.ndarray) -> tuple[int, np.ndarray]:
        for first in count(1, 128):
            seeds = np.arange(first, first + 128, dtype=np.uint64)
            places = self._place(hashes[None, :], seeds[:, None])
            fits = (self.key_at[places] < 0).all(axis=1)
            for row in np.flatnonzero(fits):
                if len(set(places[row].tolist())) == len(hashes):
                    return first + int(row), places[row]
        raise AssertionError

    def _place(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        mixed = scrambled(hashes ^ (seeds * np.uint64(0x9E3779B97F4A7C15)))
        return (mixed % np.uint64(self.n)).astype(np.int64)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the one entry that it can be."""
        hashes = self.hashes(keys)
        seed = self.seed[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        place = np.where(seed < 0, -1 - seed, self._place(hashes, np.maximum(seed, 0).astype(np.uint64)))
        return self.key_at[place]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token outside the vocabulary: lowest rank first, leftmost of equals.

    Parts are linked by where they end and where the one before starts. A heap entry is
    rank * n + start; it is stale unless ``pair`` still has that rank for the part that starts there
    and its neighbour (equal start and rank mean equal bytes).
    """
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(piece[i : i + 2], -1) for i in range(n)]
    pair[-1] = -1
    heap = [rank * n + i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        rank, left = divmod(heapq.heappop(heap), n)
        if pair[left] != rank:
            continue
        middle = end[left]
        stop = end[left] = end[middle]
        pair[middle] = pair[left] = -1
        if stop < n:
            before[stop] = left
            rank = pair[left] = get(piece[left : end[stop]], -1)
            if rank >= 0:
                heapq.heappush(heap, rank * n + left)
        if left:
            first = before[left]
            rank = pair[first] = get(piece[first:stop], -1)
            if rank >= 0:
                heapq.heappush(heap, rank * n + first)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


def _class_of(name: str, last: int) -> str:
    """Code points up to ``last`` that tiktoken's Unicode version counts in a class, as ranges."""
    bytewise = {bytes([i]): i for i in range(256)}
    probe = tiktoken.Encoding(f"class-{name}", pat_str=rf"\p{{{name}}}", mergeable_ranks=bytewise, special_tokens={})
    points = [c for c in range(128, last + 1) if not 0xD800 <= c < 0xE000]
    found = [ord(c) for c in bytes(probe.encode_ordinary("".join(map(chr, points)))).decode()]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.lru_cache(maxsize=4)
def _splitters(pattern: str) -> tuple[str, str]:
    """The pattern for texts inside the basic plane (one bit map decides), and for all texts."""
    out = []
    for last in (0xFFFF, 0x10FFFF):
        inside = {r"\p{L}": "a-zA-Z" + _class_of("L", last), r"\p{N}": "0-9" + _class_of("N", last), r"\s": SPACES}
        # a class inside brackets adds its ranges, one outside gets brackets of its own
        pieces = re.split(r"(\[[^\]]*\])", pattern)
        for name, ranges in inside.items():
            pieces = [x.replace(name, ranges if x[:1] == "[" else f"[{ranges}]") for x in pieces]
        out.append("".join(pieces).replace(r"\S", f"[^{SPACES}]"))
    return out[0], out[1]


class Codec:
    """Both directions for batches of texts; picklable, made once on the driver."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        self.entries = read_ranks(path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"))
        self.hash = PerfectHash(self.entries)
        self.patterns = _splitters(pattern or public_tokenizers.PATTERN)

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        return {entry: i for i, entry in enumerate(self.entries)}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("entries", "hash", "patterns")}

    def resolve(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        entries, ids = self.entries, self.hash.candidates(pieces).tolist()
        return [
            [i] if entries[i] == piece else merged(piece, self.ranks)
            for i, piece in zip(ids, pieces, strict=True)
        ]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a bounded number at a time."""
        basic, every = self.patterns
        compiled = re.compile(basic if text.isascii() or ord(max(text)) <= 0xFFFF else every)
        if len(text) <= STEP:
            yield compiled.findall(text)
            return
        found = (m.group() for m in compiled.finditer(text))
        while part := list(islice(found, STEP)):
            yield part

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        numbers = self._fresh()
        out: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []

        def settle() -> None:
            nonlocal numbers
            codes = np.fromiter(map(numbers["of"].__getitem__, waiting), np.int64, len(waiting))
            self._learn(numbers)
            lengths = numbers["lengths"][codes]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            inner = np.arange(total) - np.repeat(ends - lengths, lengths)
            out.append(numbers["flat"][np.repeat(numbers["starts"][codes], lengths) + inner].astype(np.int32))
            at = 0
            for text, pieces in owners:
                sizes[text] += int(lengths[at : at + pieces].sum())
                at += pieces
            waiting.clear()
            owners.clear()
            if len(numbers["of"]) > MEMORY:
                numbers = self._fresh()

        for i, text in enumerate(texts):
            for part in self.pieces(text):
                waiting += part
                owners.append((i, len(part)))
                if len(waiting) >= STEP:
                    settle()
        settle()
        return np.concatenate(out), sizes

    @staticmethod
    def _fresh() -> dict:
        empty = np.empty(0, np.int64)
        return {"of": defaultdict(count().__next__), "flat": empty, "starts": empty, "lengths": empty}

    def _learn(self, numbers: dict) -> None:
        """Resolves the pre-tokens that were numbered since the last call."""
        known = len(numbers["starts"])
        new = [text.encode() for text in islice(numbers["of"], known, None)]
        if not new:
            return
        found = self.resolve(new)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(lengths.sum()))
        starts = len(numbers["flat"]) + np.cumsum(lengths) - lengths
        for name, more in (("flat", flat), ("starts", starts), ("lengths", lengths)):
            numbers[name] = np.concatenate([numbers[name], more])


def _carried(docs: DataFrame, replaced: str, added: T.StructField) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != replaced] + [added])


def _rows_at_once(sizes: np.ndarray) -> Iterator[int]:
    """Numbers of rows, in order, whose ids together fit the 32-bit offsets of a list column."""
    rows, total = 0, 0
    for size in sizes.tolist():
        if rows and total + size > IDS_AT_ONCE:
            yield rows
            rows, total = 0, 0
        rows, total = rows + 1, total + size
    if rows:
        yield rows


def _ends(lists: pa.ListArray) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def encode(docs: DataFrame, text: str = "text", codec: Codec | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``text`` replaced by a last column of ids.

    Null and empty texts have no ids (an empty array). The ids are those that the tiktoken library
    gives for the same ranks and pattern without special tokens. All other columns stay as they
    are; ``ids`` is lengthened if one of them has that name. Repeated rows give equal rows, an empty
    table an empty result.
    """
    codec, ids = codec or Codec(), free_name(docs.columns, ids)
    schema = _carried(docs, text, T.StructField(ids, T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            flat, sizes = codec.encode([t or "" for t in batch.column(at).to_pylist()])
            names = [n for n in batch.schema.names if n != text]
            first, start = 0, 0
            for rows in _rows_at_once(sizes):
                part = sizes[first : first + rows]
                stop = start + int(part.sum())
                lists = lists_of(flat[start:stop], part)
                kept = [batch.column(i).slice(first, rows) for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*names, ids])
                first, start = first + rows, stop

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, ids: str = "ids", codec: Codec | None = None, decoded: str = "decoded") -> DataFrame:
    """``frame`` with the column of ids replaced by a last binary column of their bytes.

    Null ids give no bytes (an empty value). An id outside the vocabulary is an error. Other columns
    stay; ``decoded`` is lengthened if one of them has that name.
    """
    codec, decoded = codec or Codec(), free_name(frame.columns, decoded)
    schema = _carried(frame, ids, T.StructField(decoded, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(codec.entries, pa.binary())
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            names = [n for n in batch.schema.names if n != ids]
            first = 0
            for rows in _rows_at_once(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(first, rows)
                lists = part.column(at)
                bytes_of = pa.ListArray.from_arrays(pa.array(_ends(lists)), table.take(lists.flatten()))
                kept = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pc.binary_join(bytes_of, b"")], names=[*names, decoded])
                first += rows

    return frame.mapInArrow(run, schema)


def ids_text(ids: str = "ids") -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", F.col(ids).cast("array<string>"))
