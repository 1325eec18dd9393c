"""Best-fit packing improved by a local search over swaps.

A document is its ids and an end id. Only documents longer than a sequence are cut: into
whole sequences, before which one shorter piece holds the rest. Whole pieces have a
sequence of their own; the shorter ones are dealt evenly over blocks of about
`BLOCK` pieces, so that each block has the lengths of the whole table. A block is packed best
fit, longest piece first, and then searched: a piece moves from one
underfull sequence to another, or is exchanged for one or two pieces of another,
whenever that raises the sum of squared fills. Fuller sequences get fuller and the
emptiest ones lose their pieces, until no exchange helps or the number of sequences
is the least that the ids allow.

Defined results: NULL text counts as empty and gives the end id alone; a NULL doc_id stays NULL;
repeated rows are packed one by one; very long texts become as many pieces as they need;
pieces of equal length are interchangeable and go in the order they come in; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import with_package
from featureflow.llm.tokens import default_paths, encoder
from featureflow.session import stage, tidy

END_ID = 0
ROOM = 2048
BLOCK = 1 << 15

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"


def best_fit(lengths: Sequence[int], room: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_left: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r: a bin with r ids left
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if fits := some >> need:
            left = need + (fits & -fits).bit_length() - 1
            b = by_left[left].pop()
            if not by_left[left]:
                some &= ~(1 << left)
        else:
            b, left = len(bins), room
            bins.append([])
        bins[b].append(i)
        by_left[left - need].append(b)
        some |= 1 << (left - need)
    return bins


class Swaps:
    """Local search over the underfull bins of a block, taken fullest first.

    `single` lists the bins that hold a piece of a length, `double` those that hold two pieces of a
    summed length, both as (fill, bin) in ascending order: the emptiest bin is the one to give.
    """

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], room: int):
        self.lengths, self.room = lengths, room
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.least = -(-sum(self.fill) // room)

    def search(self) -> list[list[int]]:
        while sum(1 for b in self.bins if b) > self.least and self._pass():
            pass
        return [b for b in self.bins if b]

    def _pass(self) -> bool:
        """Tries each underfull bin against all others; True if the squared fill rose."""
        rose = False
        self.single: tuple[dict, list] = ({}, [])
        self.double: tuple[dict, list] = ({}, [])
        open_bins = [b for b, f in enumerate(self.fill) if 0 < f < self.room]
        for b in open_bins:
            self._enter(b)
        for b in sorted(open_bins, key=lambda b: -self.fill[b]):
            while 0 < self.fill[b] < self.room and self._improve(b):
                rose = True
        return rose

    def _keys(self, b: int) -> tuple[set[int], set[int]]:
        """Lengths, and sums of two lengths, in a bin. Distinct lengths are few: they add up to `room` at most."""
        count = Counter(self.lengths[i] for i in self.bins[b])
        return set(count), {x + y for x, y in combinations(count, 2)} | {2 * x for x, n in count.items() if n > 1}

    def _enter(self, b: int) -> None:
        if not 0 < self.fill[b] < self.room:
            return
        for keys, (table, order) in zip(self._keys(b), (self.single, self.double), strict=True):
            for k in keys:
                if k not in table:
                    table[k] = []
                    insort(order, k)
                insort(table[k], (self.fill[b], b))

    def _leave(self, b: int) -> None:
        for keys, (table, order) in zip(self._keys(b), (self.single, self.double), strict=True):
            for k in keys:
                own = table[k]
                del own[bisect_left(own, (self.fill[b], b))]
                if not own:
                    del table[k]
                    del order[bisect_left(order, k)]

    def _giver(self, index: tuple[dict, list], given: int, left: int, b: int) -> tuple[int, int] | None:
        """(ids, bin): the most ids, `left` more than `given` at most, that a bin emptier than `b` becomes can give."""
        table, order = index
        for at in range(bisect_right(order, given + left) - 1, bisect_right(order, given) - 1, -1):
            for fill, a in table[order[at]][:2]:
                if a != b and fill < self.fill[b] + order[at] - given:
                    return order[at], a
        return None

    def _improve(self, b: int) -> bool:
        """Makes the exchange that fills `b` most. Whoever gives was emptier than `b` becomes, so the squared fill rises."""
        left, own = self.room - self.fill[b], self.bins[b]
        piece = {self.lengths[i]: i for i in own}
        pairs = {x + y: (piece[x], piece[y]) for x, y in combinations(piece, 2)}
        for i, x in ((i, self.lengths[i]) for i in own):
            if piece[x] != i:
                pairs[2 * x] = (i, piece[x])
        moves = [((), 0, self.single), ((), 0, self.double)]
        swaps = [((i,), n, index) for n, i in piece.items() for index in (self.single, self.double)]
        best = None
        for give, given, index in chain(moves, swaps, ((p, n, self.single) for n, p in pairs.items())):
            found = self._giver(index, given, left, b)
            if found and (best is None or found[0] - given > best[0]):
                best = found[0] - given, give, index is self.double, *found
                if best[0] == left:
                    break
        if best:
            self._exchange(b, *best)
        return best is not None

    def _exchange(self, b: int, gain: int, give: tuple[int, ...], two: bool, taken: int, a: int) -> None:
        there = self.bins[a]
        if two:
            take = next(p for p in combinations(there, 2) if self.lengths[p[0]] + self.lengths[p[1]] == taken)
        else:
            take = (next(i for i in there if self.lengths[i] == taken),)
        self._leave(a)
        self._leave(b)
        self.bins[b] = [i for i in self.bins[b] if i not in give] + list(take)
        self.bins[a] = [i for i in there if i not in take] + list(give)
        self.fill[b] += gain
        self.fill[a] -= gain
        self._enter(a)
        self._enter(b)


def pack_lengths(lengths: Sequence[int], room: int = ROOM) -> list[list[int]]:
    """Bins of indices into `lengths`, none above `room`."""
    return Swaps(lengths, best_fit(lengths, room), room).search()


def cut(docs: DataFrame, room: int = ROOM, tokenizer: str | None = None, key: str = "doc_id") -> DataFrame:
    """The pieces of all documents."""
    paths = (tokenizer, None) if tokenizer else default_paths()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f.split(" ")[0] for f in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def to_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, out = encoder(*paths), np.array([END_ID], dtype="<u4").tobytes(), []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    raw, n = ids.astype("<u4", copy=False).tobytes() + end, len(ids) + 1
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start) % room or room
                        out.append((doc_id, piece, start, size, crc32(raw[4 * start : 4 * (start + size)])))
                        start, piece = start + size, piece + 1
                if len(out) >= 10_000:
                    yield to_batch(out)
                    out = []
        if out:
            yield to_batch(out)

    return with_package(rows).mapInArrow(run, PIECES)


@tidy
def pack(docs: DataFrame, room: int = ROOM, tokenizer: str | None = None, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per piece with its place in a sequence of at most `room` ids."""
    pieces = stage(cut(docs, room, tokenizer, key))
    part = F.col("length") < room
    # whole sequences are numbered evenly, blocks by odd numbers
    whole = pieces.where(~part).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = max(1, -(-pieces.where(part).count() // block))
    dealt = pieces.where(part).repartition(blocks)  # dealt in turn: no key, so no hot key
    return whole.unionByName(dealt.mapInArrow(_packing(room, block), f"{PIECES}, {PLACES}"))


def _packing(room: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packed, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal packed
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_pylist()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for own in pack_lengths(lengths, room):
                at = 0
                for i in own:
                    sequence[i], offset[i] = ((task << 40) + packed) * 2 + 1, at
                    at += lengths[i]
                packed += 1
            table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return table.to_batches()[0]

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * block:
                yield close()
                held, rows = [], 0
        if rows:
            yield close()

    return run
