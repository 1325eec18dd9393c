"""SimHash near-duplicates by a self-join over binary tries of fingerprints.

Fingerprints are 64 bits: bit i is 1 if it is set in over half the XXH64 values of
the word shingles. Two fingerprints link at `max_bits` or fewer differing bits;
classes are the connected components of the links.

The join walks a binary trie of the distinct fingerprints, two nodes at a time,
adds up the bits in which the two paths differ, and drops a pair of nodes as soon
as the budget is spent. Four tries are walked, each with another 16-bit block in
front: of 3 differing bits at least one block is free, so that in each trie the
first block allows no difference and top nodes are independent tasks. A pair of
nodes with too many fingerprints for one task is split into the pairs of its
descendants 8 levels below, as the walk itself would do.

Defined results: NULL text counts as empty; texts of fewer words than a shingle give
one shingle of all words, texts without words the fingerprint zero, which links like
any other; repeated rows share one fingerprint and so one class; a class without
any doc_id has a NULL component_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import text_of, with_package
from featureflow.llm.components import components
from featureflow.session import stage, tidy

SHINGLE = 3
MAX_BITS = 3
SEED = 42

#: Fingerprints that one task walks at once; a pair of trie nodes with more is split.
TASK_FINGERPRINTS = 1 << 17
_BLOCK = 16
_STEP = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), grams), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _tie(text: str = "text") -> Column:
    """Tells rows that repeat a doc_id with different texts apart."""
    return F.xxhash64(text_of(text))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, tied: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, with `tied` also tie, a hash of its text."""
    names = ["doc_id", "fp", "tie"] if tied else ["doc_id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names)

    tie = [_tie().alias("tie")] if tied else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *tie)
    return with_package(texts).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _close_pairs(
    left: np.ndarray, right: np.ndarray, depth: int, spent: int, max_bits: int, own: bool, frontier: int = 1 << 18
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted fingerprints within the budget below one pair of trie nodes.

    A node at depth d is a range of a sorted array whose first d bits agree. `own`:
    both nodes are the same. Work in hand is cut into pieces of `frontier` node pairs.
    """
    ones: dict[tuple[int, int], np.ndarray] = {}

    def split(side: int, values: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, d) not in ones:
            set_bits = (values >> np.uint64(63 - d)) & np.uint64(1)
            ones[side, d] = np.concatenate([[0], np.cumsum(set_bits, dtype=np.int64)])
        total = ones[side, d]
        return hi - (total[hi] - total[lo])

    one = lambda x: np.array([x], dtype=np.int64)
    work = [(one(0), one(len(left)), one(0), one(len(right)), one(spent), depth)]
    while work:
        alo, ahi, blo, bhi, err, d = work.pop()
        if len(alo) > frontier:
            for k in range(0, len(alo), frontier):
                work.append((*(x[k : k + frontier] for x in (alo, ahi, blo, bhi, err)), d))
            continue
        sizes = (ahi - alo) * (bhi - blo)
        leaf = (sizes <= 32) | (d >= 64)
        if leaf.any():
            a, na, b, nb = alo[leaf], (ahi - alo)[leaf], blo[leaf], (bhi - blo)[leaf]
            n = na * nb
            for k in _pieces(n, 1 << 20):
                which = np.repeat(np.arange(k.start, k.stop), n[k])
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                i, j = a[which] + nth // nb[which], b[which] + nth % nb[which]
                if own:
                    i, j = i[i < j], j[i < j]
                near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
                if near.any():
                    yield i[near], j[near]
        alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm = split(0, left, d, alo, ahi), split(1, right, d, blo, bhi)
        same = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err)]
        if d >= _BLOCK:  # the first block allows no difference
            twin = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), dtype=bool)
            cross = (alo, am, bm, bhi, err + 1)
            other = tuple(x[~twin] for x in (am, ahi, blo, bm, err + 1))
            same += [cross, other]
        grown = tuple(np.concatenate(x) for x in zip(*same, strict=True))
        live = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= max_bits)
        work.append((*(x[live] for x in grown), d + 1))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about `most`."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(at, stop)
        at = stop


def _join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) in a forest whose nodes all point at their root."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _turned(values: np.ndarray, k: int) -> np.ndarray:
    s = np.uint64(16 * k)
    return values if not k else (values << s) | (values >> np.uint64(64 - 16 * k))


def _walk(max_bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        turn, depth, spent = (int(group[c].iloc[0]) for c in ("turn", "depth", "spent"))
        values = _turned(group["fp"].to_numpy().view(np.uint64), turn)
        side = group["side"].to_numpy()
        own = bool((side == 2).any())
        left = np.unique(values[side != 1])
        right = left if own else np.unique(values[side == 1])
        every = left if own else np.concatenate([left, right])
        shift = 0 if own else len(left)
        parent = np.arange(len(every))
        for i, j in _close_pairs(left, right, depth, spent, max_bits, own):
            parent = _join_roots(parent, i, j + shift)
        hung = np.flatnonzero(parent != np.arange(len(every)))
        back = lambda x: _turned(x, (4 - turn) % 4).view(np.int64)
        return pd.DataFrame({"u": back(every[hung]), "v": back(every[parent[hung]])})

    return run


def close_links(distinct: DataFrame, max_bits: int = MAX_BITS, task_rows: int = TASK_FINGERPRINTS) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints (column fp) within `max_bits` bits.

    Only a spanning forest of each pair of nodes leaves its task, never all pairs.
    """
    if max_bits > 3:
        raise ValueError("four blocks find up to 3 differing bits")
    distinct = stage(distinct.select("fp"))
    n = distinct.count()
    top = min(_BLOCK, max(2, math.ceil(math.log2(max(n, 1) / (task_rows / 8) + 1))))
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), (_rotl("fp", k)).alias("rot")) for k in range(4)]))
    rows = distinct.select("fp", turns.alias("t")).select("fp", "t.turn", "t.rot")
    head = F.shiftrightunsigned("rot", 64 - top)
    rows = rows.select("fp", "turn", "rot", F.lit(top).alias("depth"), F.lit(0).alias("spent"), head.alias("a"), head.alias("b"), F.lit(2).alias("side"))
    key, found = ["turn", "depth", "spent", "a", "b"], None
    while True:
        counts = rows.groupBy(*key).count()
        large = stage(counts.where(F.col("count") > task_rows).where("depth < 64").select(*key))
        split = not large.isEmpty()
        here = rows.join(F.broadcast(large) if _few(large) else large, key, "left_anti") if split else rows
        walked = with_package(here).groupBy(*key).applyInPandas(_walk(max_bits), "u long, v long")
        found = walked if found is None else found.unionByName(walked)
        if not split:
            return found
        rows = stage(_descend(rows.join(F.broadcast(large) if _few(large) else large, key, "left_semi"), max_bits))


def _few(df: DataFrame) -> bool:
    return df.limit(10_001).count() <= 10_000


def _rotl(column: str, k: int):
    c = F.col(column)
    return c if not k else F.shiftleft(c, 16 * k).bitwiseOR(F.shiftrightunsigned(c, 64 - 16 * k))


def _descend(rows: DataFrame, max_bits: int) -> DataFrame:
    """The rows of node pairs, dealt to the pairs of nodes up to 8 levels below."""
    step = F.when(F.col("depth") < _BLOCK, F.least(F.lit(_STEP), _BLOCK - F.col("depth"))).otherwise(F.lit(_STEP))
    below = rows.withColumn("step", step.cast("int"))
    child = F.expr("shiftrightunsigned(rot, 64 - depth - step) & (shiftleft(1L, step) - 1)")
    below = below.withColumn("child", child)
    masks = [m for m in range(1 << _STEP) if m.bit_count() <= max_bits]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    allowed = F.filter(flips, lambda m: F.when(F.col("depth") < _BLOCK, m == 0).otherwise(F.bit_count(m) + F.col("spent") <= max_bits))
    below = below.withColumn("flip", F.explode(allowed)).withColumn("mate", F.col("child").bitwiseXOR(F.col("flip")))
    down = lambda c, x: F.expr(f"shiftleft({c}, step) | {x}")
    first = F.when(F.col("side") == 2, F.least("child", "mate")).when(F.col("side") == 0, F.col("child")).otherwise(F.col("mate"))
    second = F.when(F.col("side") == 2, F.greatest("child", "mate")).when(F.col("side") == 0, F.col("mate")).otherwise(F.col("child"))
    side = F.when(F.col("side") != 2, F.col("side")).when(F.col("flip") == 0, 2).when(F.col("child") < F.col("mate"), 0).otherwise(1)
    below = below.withColumn("x", first).withColumn("y", second)
    return below.select(
        "fp", "turn", "rot", (F.col("depth") + F.col("step")).alias("depth"),
        (F.col("spent") + F.bit_count("flip")).cast("int").alias("spent"),
        down("a", "x").alias("a"), down("b", "y").alias("b"), side.alias("side"),
    )


def _classed(docs: DataFrame, shingle: int, max_bits: int, tied: bool = False) -> DataFrame:
    """The columns of `fingerprints` with root and component_id of every row's class."""
    prints = stage(fingerprints(docs, shingle, tied))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    star = components(close_links(distinct, max_bits))
    rooted = distinct.join(star.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(member, "fp")


@tidy
def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of `docs`."""
    out = _classed(docs, shingle, max_bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@tidy
def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs`, all columns, one for each class: that of its smallest doc_id.

    Rows that repeat a doc_id and its text are copies and one of them stays; with
    another text they stand for themselves, in the class of that text. Rows without
    a doc_id can't be named as copies of one another; they all stay.
    """
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values())
    key = F.col(at["doc_id"])
    named = docs.where(F.col("doc_id").isNotNull())
    first = _classed(named, shingle, max_bits, tied=True).groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("x"))
    stays = first.select(F.col("x.doc_id").alias("keep_id"), F.col("x.tie").alias("keep_tie"))
    rows = plain.withColumn("tie", _tie(at["text"]))
    out = rows.join(stays, (key == F.col("keep_id")) & (F.col("tie") == F.col("keep_tie")), "left_semi").dropDuplicates([at["doc_id"], "tie"])
    out = out.drop("tie").unionByName(plain.where(key.isNull()))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
