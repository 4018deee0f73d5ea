"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Documents longer than a sequence are cut, and the pieces are dealt by hash to groups of bounded
size and packed there: best fit in falling length, then local search between all bins that
are not full. The search lets an emptier bin lose length to a fuller one,
by moving a piece, by exchanging one piece for one shorter, or one piece for two
that are shorter together. Each step raises the sum of squared fills; a bin that
becomes empty is gone. The search ends when a group has no more bins than its tokens need, or when
none of the bins too many has a step left. Only piece lengths are shuffled, never text or ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored
from ledgerspark.llm.tokens import VOCABULARY, encoder


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    end_id: int = 2
    vocabulary: str = VOCABULARY
    group_size: int = 20_000
    search_steps: int = 20_000  # of a group; a step each for as many pieces as it has
    search_window: int = 64  # takers looked at together; the best step among them is taken


PIECES = "row_id long, doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: the first may be shorter, the others are full."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def cutter(params: PackParams, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(params.vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                columns = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                rows, ids = [], []
                for row, doc, text in zip(columns["row_id"], columns["doc_id"], columns["text"]):
                    tokens = np.array([*encode(text or ""), params.end_id], "<u4")
                    for place, (start, length) in enumerate(cut(len(tokens), params.capacity)):
                        own = tokens[start : start + length]
                        rows.append((row, doc, place, start, length, zlib.crc32(own)))
                        ids.append(own.astype(np.int32))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names = [*(field.split()[0] for field in PIECES.split(", ")), "ids"][: len(arrays)]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places (indexes) of each bin; lengths must fall."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set where a bin has room r
    for at, length in enumerate(lengths):
        enough = rooms >> length
        if enough:
            room = length + (enough & -enough).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, number = capacity, len(bins)
            bins.append([])
        bins[number].append(at)
        left = room - length
        if left:
            by_room[left].append(number)
            rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], params: PackParams) -> list[list[int]]:
    """Empties bins by moves and exchanges while these raise the sum of squared fills.

    Donors are the emptiest bins, twice as many as there are too many; takers are all bins with room.
    """
    search = _Search(bins, lengths, params)
    steps = 0
    while steps < params.search_steps and search.step():
        steps += 1
    return list(search.held.values())


class _Search:
    def __init__(self, bins: list[list[int]], lengths: list[int], params: PackParams):
        self.lengths, self.params = lengths, params
        self.capacity, self.least = params.capacity, -(-sum(lengths) // params.capacity)
        self.held = {number: list(held) for number, held in enumerate(bins)}
        self.fill = {number: sum(lengths[i] for i in held) for number, held in self.held.items()}
        self.open = sorted((n for n, full in self.fill.items() if full < params.capacity), key=self._order)
        self.sizes = {number: self._sorted(number) for number in self.open}

    def _order(self, number: int) -> tuple[int, int]:
        return self.fill[number], number

    def _sorted(self, number: int) -> list[tuple[int, int]]:
        return sorted((self.lengths[i], i) for i in self.held[number])

    def step(self) -> bool:
        """One move or exchange out of the emptiest donor that has one; False if none has."""
        excess, window = len(self.held) - self.least, self.params.search_window
        for donor in self.open[: 2 * excess]:
            for size, item in reversed(self.sizes[donor]):
                for start in range(0, len(self.open), window):
                    best = self._best(size, donor, self.open[start : start + window])
                    if best:
                        self._exchange(item, best[2], donor, best[1])
                        return True
        return False

    def _best(self, size: int, donor: int, takers: list[int]) -> tuple[int, int, list[int]] | None:
        """(gain in squared fill, taker, pieces given back) of the best step for a piece."""
        best = None
        for taker in takers:
            if taker == donor:
                continue
            for change, back in self._options(size, taker):
                gain = change * (self.fill[taker] - self.fill[donor] + change)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, taker, back)
        return best

    def _options(self, size: int, taker: int):
        """Net length won by the bin that takes the piece, with what it gives back."""
        room = self.capacity - self.fill[taker]
        if size <= room:
            yield size, []
            return
        sizes = self.sizes[taker]
        at = bisect_left(sizes, (size - room, -1))
        if at < len(sizes) and sizes[at][0] < size:
            yield size - sizes[at][0], [sizes[at][1]]
        for i, (one, first) in enumerate(sizes):
            j = bisect_left(sizes, (size - room - one, -1), i + 1)
            if j < len(sizes) and one + sizes[j][0] < size:
                yield size - one - sizes[j][0], [first, sizes[j][1]]

    def _exchange(self, item: int, back: list[int], donor: int, taker: int) -> None:
        self.held[donor].remove(item)
        self.held[taker].append(item)
        for other in back:
            self.held[taker].remove(other)
            self.held[donor].append(other)
        for number in (donor, taker):
            self.open.pop(bisect_left(self.open, self._order(number), key=self._order))
            self.fill[number] = sum(self.lengths[i] for i in self.held[number])
            if not self.held[number]:
                del self.held[number]
            elif self.fill[number] < self.capacity:
                self.sizes[number] = self._sorted(number)
                insort(self.open, number, key=self._order)


def group_packer(params: PackParams):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = rows["length"].tolist()
        bins = local_search(best_fit(lengths, params.capacity), lengths, params)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for number, held in enumerate(bins):
            at = 0
            for i in held:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        rows["sequence_id"] = (rows["pack_group"].to_numpy() << 32) | sequence
        rows["offset"] = offset
        return rows[["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: PackParams | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: row_id, doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: such a document is its end id alone. Rows repeated with one id
    are documents of their own (``row_id`` tells them apart). ``with_ids`` adds the piece's ids. An
    empty table gives an empty result.
    """
    params = params or PackParams()
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = stored(read.mapInArrow(cutter(params, with_ids), schema), "pack-pieces")
    groups = max(1, -(-pieces.count() // params.group_size))
    light = pieces.select(*(field.split()[0] for field in PIECES.split(", ")))
    dealt = light.withColumn("pack_group", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)))
    packed = dealt.groupBy("pack_group").applyInPandas(
        group_packer(params),
        "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
    if with_ids:
        packed = packed.join(pieces.select("row_id", "piece", "ids"), ["row_id", "piece"])
    return packed


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed ``with_ids``: at most one sequence's ids per row."""
    placed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return placed.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
