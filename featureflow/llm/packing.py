"""Vector bin packing of token sequences by the dot-product heuristic.

An example has three demands: tokens, segments (one) and loss-bearing tokens. A
sequence is filled by the example, among those that fit whole, with the largest
dot product of its demands and what the sequence has left, both as shares of the
limits. Where nothing fits whole, an example is cut so that the sequence is full.

Each task packs its own rows: whole-sequence pieces leave at once, the rest waits in
a pool of bounded size. What another limit than tokens closes, and what a task has left
at its end, goes out in sequences whose length is a power of two, so that they need no
padding either; only a rest below `min_cut` ids is padded.

Defined results: NULL text counts as empty and gives the end id alone; repeated
rows are packed one by one; very long texts fill sequences of their own, their rest waits like
any other; of equal dot products the example that came first goes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import with_package
from featureflow.llm.tokens import default_paths, encoder

END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and the shortest piece that a cut may leave in it."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    min_cut: int = 16
    pool: int = 2048


@dataclass(slots=True)
class Piece:
    """Ids `ids` of one example, beginning at its id `start`; `bears` marks loss-bearing ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    bears: np.ndarray
    total: int

    @property
    def loss(self) -> int:
        """Ids with loss: the first id of a piece has nothing before it to be predicted from."""
        return int(self.bears[1:].sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[:n], self.bears[:n], self.total)
        return head, Piece(self.doc_id, self.start + n, self.ids[n:], self.bears[n:], self.total)

    def fitting(self, limits: Limits) -> int:
        """The most ids of its front within the token and loss limits."""
        if self.loss <= limits.loss:
            return min(len(self.ids), limits.tokens)
        within = int(np.searchsorted(np.cumsum(self.bears[1:]), limits.loss, side="right")) + 1
        return max(1, min(within, limits.tokens))


def _row(p: Piece, sequence: int, offset: int) -> tuple:
    return (p.doc_id, p.start, len(p.ids), crc32(p.ids.astype("<u4").tobytes()), p.total, sequence, offset, p.loss)


class Packer:
    """Packs the examples of one task; sequences are numbered from `first`."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.sequence, self.pool = limits, first, []
        self._spans = np.array([limits.tokens, limits.segments, max(limits.loss, 1)], dtype=float)

    def add(self, example: Piece) -> Iterator[tuple]:
        while len(example.ids) >= self.limits.tokens or example.loss > self.limits.loss:
            if (n := example.fitting(self.limits)) == len(example.ids):
                yield from self._close([example])
                return
            head, example = example.cut(n)
            yield from self._close([head]) if n == self.limits.tokens else self._wait(head)
        yield from self._wait(example)

    def _wait(self, piece: Piece) -> Iterator[tuple]:
        self.pool.append(piece)
        if len(self.pool) >= self.limits.pool:
            yield from self._pack(self.limits.pool // 4)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)

    def _close(self, pieces: Sequence[Piece]) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield _row(p, self.sequence, offset)
            offset += len(p.ids)
        self.sequence += 1

    def _pack(self, leave: int) -> Iterator[tuple]:
        """Full sequences out of the pool until `leave` pieces wait; all of them if 0."""
        lim = self.limits
        pieces = self.pool
        need = np.array([(len(p.ids), 1, p.loss) for p in pieces], dtype=float).reshape(-1, 3)
        live = np.ones(len(pieces), dtype=bool)
        while (waiting := int(live.sum())) > leave:
            room, own = self._spans.copy(), []
            while live.any():
                fits = live & (need <= room).all(axis=1)
                if fits.any() and not (room[1] == 1 and need[fits, 0].max() < room[0]):
                    score = np.where(fits, (need / self._spans) @ (room / self._spans), -1.0)
                    k = int(score.argmax())
                    own.append(pieces[k])
                    live[k] = False
                    room -= need[k]
                else:  # cut the longest piece to what is left, if the limits and the rest allow it
                    k = int(np.where(live, need[:, 0], -1).argmax())
                    n = min(int(room[0]), pieces[k].fitting(Limits(int(room[0]), 1, int(room[2])))) if room[0] >= 1 and room[1] >= 1 else 0
                    if n < lim.min_cut or len(pieces[k].ids) - n < 1:
                        if fits.any():
                            k = int(np.where(fits, need[:, 0], -1).argmax())
                            own.append(pieces[k])
                            live[k] = False
                            room -= need[k]
                            continue
                        break
                    head, pieces[k] = pieces[k].cut(n)
                    own.append(head)
                    need[k] = (len(pieces[k].ids), 1, pieces[k].loss)
                    room -= (n, 1, head.loss)
                if room[0] < 1 or room[1] < 1:
                    break
            if room[0] >= lim.min_cut:  # closed by another limit than tokens, or the last one
                yield from self._close_short(own)
            else:
                yield from self._close(own)
            if len(own) == 0 and int(live.sum()) == waiting:
                raise RuntimeError("no piece fits an empty sequence")
        self.pool = [p for p, there in zip(pieces, live, strict=True) if there]

    def _close_short(self, own: list[Piece]) -> Iterator[tuple]:
        """Ids that don't fill a sequence, in sequences of falling powers of two."""
        left = sum(len(p.ids) for p in own)
        while left:
            size = 1 << (left.bit_length() - 1)
            if size < self.limits.min_cut:
                size = left
            part, got = [], 0
            while got < size:
                p = own.pop(0)
                if got + len(p.ids) > size:
                    head, rest = p.cut(size - got)
                    own.insert(0, rest)
                    p = head
                part.append(p)
                got += len(p.ids)
            yield from self._close(part)
            left -= size


def pack(
    examples: DataFrame, parts: Sequence[tuple[str, bool]] = (("text", True),), limits: Limits = Limits(), tokenizer: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """One row per piece: where its ids lie in their example and in which sequence.

    `parts` names the text columns of an example in their order and whether their
    ids bear loss (a prompt's don't); the end id bears loss as the last part does.
    """
    paths = (tokenizer, None) if tokenizer else default_paths()
    names = [f"t{i}" for i in range(len(parts))]
    rows = examples.select(F.col(key).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(n) for n, (c, _) in zip(names, parts, strict=True)])
    return with_package(rows).mapInArrow(_packing(paths, [b for _, b in parts], limits), PIECES)


def _packing(paths: tuple[str, str | None], bears: Sequence[bool], limits: Limits) -> Callable:
    fields = [f.strip().split(" ")[0] for f in PIECES.split(",")]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        enc, out = encoder(*paths), []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [enc.encode(part.column(1 + i).to_pylist()) for i in range(len(bears))]
                for doc_id, *own in zip(part.column(0).to_pylist(), *ids, strict=True):
                    whole = np.concatenate([*own, np.array([END_ID], dtype="<u4")])
                    marks = np.concatenate([*(np.full(len(x), b) for x, b in zip(own, bears, strict=True)), [bears[-1]]])
                    out += packer.add(Piece(doc_id, 0, whole, marks, len(whole)))
                if len(out) >= 10_000:
                    yield to_batch(out)
                    out = []
        out += packer.finish()
        if out:
            yield to_batch(out)

    return run
