"""Audit of filters in every order, by wide packed counters.

A document's failures are a mask of bits, one per filter. For a given mask the outcome
of every step of every order of the filters is known, so each mask (with the
labels it comes with) maps to one big integer whose fields hold all of them: six counts
for each of the 120 x 5 steps of five filters. Adding a document's integer to its part's
sum counts all 600 steps at once. A field is `FIELD_BYTES` wide, room for 2^48 documents, so no
field runs into the next one. Integers are summed in the tasks, then in a second and a
third shuffle of sums (a part's sums are dealt over `SPREAD` groups first), and unpacked at the end.

The equality filter needs the whole table: rows that agree in text, part and labels are
counted together before they meet, so that a text that a third of the rows hold
reaches one task as one row per map task. Such rows add their integer times their number.

Defined results: NULL text counts as empty; NULL lang is the part of the empty string; a
NULL doc_id is neither smaller nor larger than another, has no labels, and its text doesn't
fail by equality, nor make others fail. Rows that repeat a doc_id count one by one; equal texts fail
only by a smaller doc_id. A document has a label if any row of `labels` for its doc_id
says so. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import WORD, with_package
from featureflow.session import stage, tidy

FIELD_BYTES = 6
SPREAD = 64
#: Sums a task holds at once; beyond it they go out and are added in the next shuffle.
MOST_SUMS = 512

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
#: Bytes of UTF-8 after the first of a code point.
_LATER = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bounds:
    """Least words, least percentage of distinct words, most percentage of capitals."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10


#: Letters of the filters in the order of their bits; the last one is the equality filter.
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def packed(letters: str = LETTERS) -> dict[tuple[int, bool, bool], int]:
    """The big integer of every (mask, good, toxic): `COUNTS` of each step of each order, lowest field first."""
    bits = {x: 1 << i for i, x in enumerate(letters)}
    out = {}
    for mask in range(1 << len(letters)):
        for good in (False, True):
            for toxic in (False, True):
                fields = bytearray()
                for order in orders(letters):
                    alive = True
                    for x in order:
                        fails = bool(mask & bits[x])
                        here = alive and fails
                        step = (alive and not fails, here, fails and not alive, mask == bits[x], here and good, here and toxic)
                        for value in step:
                            fields += int(value).to_bytes(FIELD_BYTES, "little")
                        alive = alive and not fails
                out[mask, good, toxic] = int.from_bytes(bytes(fields), "little")
    return out


def unpacked(total: int, letters: str = LETTERS) -> np.ndarray:
    """Counts of a sum, as orders x steps x COUNTS."""
    n, k = len(orders(letters)), len(letters)
    size = n * k * len(COUNTS)
    raw = np.frombuffer(total.to_bytes(size * FIELD_BYTES, "little"), dtype=np.uint8).reshape(size, FIELD_BYTES)
    wide = np.zeros((size, 8), dtype=np.uint8)
    wide[:, :FIELD_BYTES] = raw
    return wide.view("<i8").reshape(n, k, len(COUNTS))


def text_mask(text: bytes, bounds: Bounds) -> int:
    """Bits of the filters that need nothing but the text."""
    words = text.split()  # of bytes: at ASCII white space only
    n = len(words)
    points = len(text) if text.isascii() else len(text.translate(None, _LATER))
    capitals = len(text) - len(text.translate(None, _UPPER))
    few = n < bounds.words
    dull = 100 * len(set(words)) < bounds.distinct * n
    loud = 100 * capitals > bounds.capitals * points
    signs = len(text.translate(None, _SYMBOLS)) < len(text)
    return few | dull << 1 | loud << 2 | signs << 3


def measured(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """doc_id, part, mask of the text's own filters and a digest of the text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text")
    )
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            masks = pa.array([text_mask(t, bounds) for t in texts], pa.int32())
            digests = pa.array([sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), masks, digests], schema=schema)

    return with_package(rows).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with good and toxic. Rows without a doc_id don't go through the join."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    no = F.lit(False)
    joined = rows.where("doc_id IS NOT NULL").join(known.where("good OR toxic"), "doc_id", "left")
    joined = joined.select(*rows.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return joined.unionByName(rows.where("doc_id IS NULL").select("*", no.alias("good"), no.alias("toxic")))


def masked(rows: DataFrame) -> DataFrame:
    """Numbers of documents `n` by part, mask (equality filter included), good and toxic, in many rows.

    A row of the aggregates stands for one text; `first` of its `n` documents hold the text's least doc_id.
    """
    alike = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    lone = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("lone")
    held = F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("held")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    texts = by_id.groupBy(*alike).agg(held, lone, least)
    firsts = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"), F.collect_list(F.struct("mask", "part", "good", "toxic", "held", "lone", "least")).alias("kinds"))
    kinds = firsts.select("first_id", F.explode("kinds").alias("k")).select("first_id", "k.*")
    first = F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(F.lit(0))
    again = 1 << (len(LETTERS) - 1)
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("lone") + first).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(again)).alias("mask"), (F.col("held") - first).alias("n")),
    )
    return kinds.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")


def _summing(number: Callable[[pa.RecordBatch], Iterator[tuple[str, int]]]) -> Callable:
    """A task's sums of big integers by part."""
    schema = pa.schema([("part", pa.string()), ("total", pa.binary())])

    def out(sums: dict[str, int]) -> pa.RecordBatch:
        values = [t.to_bytes((t.bit_length() + 7) // 8, "little") for t in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(values, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            for part, value in number(batch):
                sums[part] = sums.get(part, 0) + value
                if len(sums) > MOST_SUMS:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    return run


def _of_masks(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    integers = _integers()
    for part, good, toxic, mask, n in zip(*(batch.column(c).to_pylist() for c in ("part", "good", "toxic", "mask", "n")), strict=True):
        value = integers[mask, good, toxic]
        yield part, value if n == 1 else n * value


def _of_sums(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    for part, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield part, int.from_bytes(total, "little")


_KNOWN: dict[tuple[int, bool, bool], int] = {}


def _integers() -> dict[tuple[int, bool, bool], int]:
    """The packed integers, made once per Python worker."""
    if not _KNOWN:
        _KNOWN.update(packed())
    return _KNOWN


def totals(masks: DataFrame) -> DataFrame:
    """One row per part: the sum of its documents' integers."""
    sums = "part string, total binary"
    here = with_package(masks).mapInArrow(_summing(_of_masks), sums)
    dealt = here.withColumn("salt", (F.xxhash64("total") % SPREAD).cast("int")).repartition("part", "salt").select("part", "total")
    near = dealt.mapInArrow(_summing(_of_sums), sums)
    # one task sums a part from here on: at most SPREAD rows of it come in
    return near.repartition("part").sortWithinPartitions("part").mapInArrow(_summing_sorted, sums)


def _summing_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by part."""
    part, total = None, 0
    schema = pa.schema([("part", pa.string()), ("total", pa.binary())])
    row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([total.to_bytes((total.bit_length() + 7) // 8, "little")], pa.binary())], schema=schema)
    for batch in batches:
        for name, value in _of_sums(batch):
            if name != part and part is not None:
                yield row()
                total = 0
            part, total = name, total + value
    if part is not None:
        yield row()


def _unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = orders()
    at = {x: np.array([o.index(x) for o in names]) for x in LETTERS}
    rows = np.arange(len(names))
    step = np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(names))
    letter = [x for o in names for x in o]
    for batch in batches:
        for part, total in _of_sums(batch):
            counts = unpacked(total)
            shapley = {x: int(counts[rows, at[x], COUNTS.index("removed")].sum()) for x in LETTERS}
            columns = [pa.array([part] * len(letter)), pa.array([o for o in names for _ in o]), pa.array(step)]
            columns += [pa.array(counts[:, :, i].reshape(-1)) for i in range(len(COUNTS))]
            columns.append(pa.array([shapley[x] for x in letter], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS, "shapley"])


@tidy
def audit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """One row per part, order of the filters and step; counts of documents within the part."""
    rows = stage(measured(docs, bounds))  # read twice: with and without doc_id
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return totals(masked(labelled(rows, labels))).mapInArrow(_unpacking, schema)


def audit_sql(bounds: Bounds = Bounds()) -> str:
    """The query's result in DuckDB's SQL."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
    return rf"""
WITH RECURSIVE f(x, b) AS (VALUES {letters}),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, f WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, i::INTEGER AS step, x, b, (SELECT coalesce(sum(g.b), 0) FROM f g WHERE contains(filter_order[1:i - 1], g.x))::INTEGER AS before
      FROM (SELECT *, unnest(range(1, {len(LETTERS) + 1})) AS i FROM o WHERE length(filter_order) = {len(LETTERS)}) p JOIN f ON f.x = p.filter_order[i]),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(ws) < {bounds.words})::INTEGER + 2 * (100 * len(list_distinct(ws)) < {bounds.distinct} * len(ws))::INTEGER
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {bounds.capitals} * length(text))::INTEGER
        + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask
      FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, x,
        coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
        coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0 AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0 AND toxic), 0) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r"""

