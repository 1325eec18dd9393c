"""Scoring many candidate expressions in one job (G1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.numbers import NUMERIC, finite
from featureflow.operators.sampling import with_fold
from featureflow.session import broadcast_if_small, compiled_methods, stage

#: Wider aggregates outgrow the method size that the JVM compiles; they run in pieces.
CHUNK = 25
#: Values that an Arrow column holds plainly, and those of them that travel as text.
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
FLAT = (*NUMERIC, *TIMES, T.BooleanType, T.StringType)
#: Numbers of a block that a task holds at once, whatever the number of candidates.
CELLS = 1 << 19
MOMENTS = "fold int, i int, n long, mx double, my double, sx double, sy double, sxy double, x0 double, x1 double, y0 double, y1 double"


def candidate_types(df: DataFrame, exprs: dict[str, str]) -> tuple[dict, dict[str, str]]:
    """({name: type} of expressions the schema accepts, {name: error} of the others)."""
    names = list(exprs)
    try:  # one analysis serves all when all are sound
        schema = df.select(*[F.expr(exprs[n]).alias(f"c{i}") for i, n in enumerate(names)]).schema
        return {n: schema[f"c{i}"].dataType for i, n in enumerate(names)}, {}
    except Exception:  # analysis errors only: nothing has run
        if len(names) == 1:
            return {}, {names[0]: _reason(df, exprs[names[0]])}
    good, bad = {}, {}
    for part in (names[: len(names) // 2], names[len(names) // 2 :]):
        g, b = candidate_types(df, {n: exprs[n] for n in part})
        good.update(g)
        bad.update(b)
    return good, bad


def _reason(df: DataFrame, expr: str) -> str:
    try:
        df.select(F.expr(expr))
    except Exception as err:
        return str(err).splitlines()[0][:200]
    return "not analysable"


def score_candidates(df: DataFrame, exprs: dict[str, str], y: str, k: int = 1, key=None, seed: int = 0) -> DataFrame:
    """(candidate, fold, score, rows): strength of each candidate on each of k folds.

    Numbers and booleans: |Pearson correlation| with y over the rows that have both, all
    candidates in one scan. Text: correlation ratio (share of the spread of y between the
    values, as a root). Sums are taken around means, so they do not cancel. The result has
    candidates x folds rows.
    """
    types, _ = candidate_types(df, exprs)
    folded = with_fold(df, k, key, seed) if k > 1 else df.withColumn("fold", F.lit(0))
    target = F.col(y).cast("double")
    numeric = [n for n, t in types.items() if isinstance(t, NUMERIC) or t.typeName() == "boolean"]
    textual = [n for n, t in types.items() if t.typeName() == "string"]
    parts = []
    if numeric:
        values = [finite(F.expr(exprs[n]).cast("double"), _double()).alias(f"c{i}") for i, n in enumerate(numeric)]
        rows = folded.where(target.isNotNull()).select(F.col("fold").cast("int").alias("fold"), target.alias("_y"), *values)
        found = _correlations(rows)
        name = F.get(F.array(*[F.lit(n) for n in numeric]), F.col("i"))
        parts.append(found.select(name.alias("candidate"), "fold", F.when(F.abs("r") > 1, 1.0).otherwise(F.abs("r")).alias("score"), "rows"))
    if textual:
        middle = df.agg(F.avg(target)).first()[0] or 0.0
        target = target - F.lit(middle)
        v = F.explode(
            F.array(*[F.struct(F.lit(n).alias("candidate"), F.expr(exprs[n]).alias("v")) for n in textual])
        )
        cells = (
            folded.select("fold", target.alias("_y"), v.alias("c"))
            .where(F.col("c.v").isNotNull() & F.col("_y").isNotNull())
            .groupBy("fold", "c.candidate", "c.v")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
        )
        between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
        total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
        parts.append(
            cells.groupBy("candidate", "fold").agg(
                F.sqrt(F.greatest(F.try_divide(between, total), F.lit(0.0))).alias("score"), F.sum("n").alias("rows")
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "candidate string, fold int, score double, rows bigint")
    out = reduce(lambda a, b: a.unionByName(b), [p.select("candidate", "fold", "score", "rows") for p in parts])
    return out.withColumn("score", finite(F.col("score"), _double()))


def _correlations(rows: DataFrame) -> DataFrame:
    """(fold, i, r, rows) of the columns c0, c1, ... of `rows` with `_y`, in one pass.

    A task keeps a block of co-moments per fold: count, means, sums of squares and products
    around the means, for all candidates side by side. Blocks merge by the pairwise
    formula, inside the task and then over the tasks' blocks.
    """
    with compiled_methods(rows.sparkSession):
        return _merged_blocks(stage(rows.mapInArrow(_co_moments(len(rows.columns) - 2), MOMENTS)))


def _merged_blocks(blocks: DataFrame) -> DataFrame:
    """(fold, i, r, rows) of the tasks' blocks, rows of MOMENTS."""
    key = ["fold", "i"]
    mean = lambda m: F.try_divide(F.sum(F.col("n") * F.col(m)), F.sum("n"))
    flat = (F.min("x0") == F.max("x1")) | (F.min("y0") == F.max("y1"))  # a constant side gives no score
    whole = stage(blocks.groupBy(*key).agg(F.sum("n").alias("rows"), mean("mx").alias("ax"), mean("my").alias("ay"), flat.alias("flat")))
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    sums = (
        blocks.join(broadcast_if_small(whole), key)
        .groupBy(*key, "rows", "flat")
        .agg(
            F.sum(F.col("sx") + F.col("n") * dx * dx).alias("sx"), F.sum(F.col("sy") + F.col("n") * dy * dy).alias("sy"),
            F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        )
    )
    r = F.when(~F.col("flat"), F.try_divide(F.col("sxy"), F.sqrt("sx") * F.sqrt("sy")))
    return sums.select(*key, r.alias("r"), "rows")


def _moments() -> tuple[Callable, Callable]:
    """What makes a block of rows and what merges two blocks."""

    def block(x: np.ndarray, y: np.ndarray) -> tuple:
        """n, means, sums around the means and extremes per column. Values are moved by the first of their column, so equal ones cancel."""
        there = ~np.isnan(x)
        n = there.sum(axis=0)
        first = x[there.argmax(axis=0), np.arange(x.shape[1])]
        x = np.where(there, x, first)
        moved = x - first
        share = np.maximum(n, 1)
        mx = moved.sum(axis=0) / share
        dx = np.where(there, moved - mx, 0.0)
        own = y - y[0]
        my = own @ there / share
        dy = np.where(there, own[:, None] - my, 0.0)
        wide = np.where(there, y[:, None], np.nan)
        return (
            n, np.where(n, mx + first, 0.0), np.where(n, my + y[0], 0.0), (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0),
            np.fmin.reduce(x), np.fmax.reduce(x), np.fmin.reduce(wide), np.fmax.reduce(wide),
        )

    def merged(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        share = np.maximum(n, 1)
        dx, dy = np.where(a[0] * b[0], b[1] - a[1], 0.0), np.where(a[0] * b[0], b[2] - a[2], 0.0)
        weight = a[0] * (b[0] / share)
        mean = lambda i, d: np.where(a[0], a[i] + d * (b[0] / share), b[i])
        sums = (a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight)
        return n, mean(1, dx), mean(2, dy), *sums, np.fmin(a[6], b[6]), np.fmax(a[7], b[7]), np.fmin(a[8], b[8]), np.fmax(a[9], b[9])

    return block, merged


def _co_moments(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's blocks: rows (fold, _y, c0, ...) in, one row of MOMENTS per fold and candidate out."""
    names = [f.split(" ")[0] for f in MOMENTS.split(", ")]
    step = max(1, CELLS // max(1, width))

    block, merged = _moments()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[int, tuple] = {}
        with np.errstate(all="ignore"):  # sums beyond the doubles are no score
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    fold, y = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                    x = np.column_stack([part.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
                    for f in np.unique(fold):
                        here = fold == f
                        new = block(x[here], y[here])
                        folds[f] = merged(folds[f], new) if f in folds else new
        for f, sums in folds.items():
            columns = [np.full(width, f, dtype=np.int32), np.arange(width, dtype=np.int32), sums[0].astype(np.int64), *sums[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names)

    return run


def _double():
    from pyspark.sql.types import DoubleType

    return DoubleType()


#: Places of the lowest bits of the parts of a hash; sums of 22-bit parts are whole for 2^41 rows.
PLACES = (0, 21, 42)


def _hash_parts(h: Column) -> dict[int, Column]:
    """A long as sum of parts times powers of two, so that sums of many need no decimals."""
    low = F.lit((1 << PLACES[1]) - 1).cast("long")
    return {at: F.shiftright(h, at) if at == PLACES[-1] else F.shiftright(h, at).bitwiseAND(low) for at in PLACES}


def _joined_parts(name: str) -> Column:
    """The sum of the hashes whose parts were summed."""
    parts = [(F.col(f"{name}_{at}").cast("decimal(20,0)") * F.lit(1 << at).cast("decimal(15,0)")).cast("decimal(38,0)") for at in PLACES]
    return reduce(lambda a, b: (a + b).cast("decimal(38,0)"), parts)


#: What a task says of a candidate: rows, values, their sum, least and greatest value as text, parts of the sum of hashes.
QUALITY = "i int, n long, there long, s double, a string, z string, " + ", ".join(f"f_{at} long" for at in PLACES)
#: The same with the co-moments of the rows that have a target; `m` counts those of them with a value, without any there is no fold.
MOMENTS_OF = [f.split(" ")[0] for f in MOMENTS.split(", ")[3:]]
JUDGED = f"{QUALITY}, fold int, m long, " + ", ".join(f"{c} double" for c in MOMENTS_OF)


def candidate_quality(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """(candidate, nulls, constant, mean, fingerprint), numbers, booleans, texts and times in one scan.

    Floating values that are not finite count as null. Equal fingerprints (a sum of row and
    value hashes, so that repeated rows don't cancel) mark copies. The mean is NULL for text.
    """
    types, _ = candidate_types(df, exprs)
    row_hash = _row_hash(df)
    names = [n for n in exprs if n in types]
    flat = [n for n in names if isinstance(types[n], FLAT)]
    parts = [_quality(_folded(df, exprs, types, flat, row_hash), flat)] if flat else []
    other = [n for n in names if n not in set(flat)]
    for at in range(0, len(other), CHUNK):
        parts.append(_nested_quality(df, exprs, types, other[at : at + CHUNK], row_hash))
    with compiled_methods(df.sparkSession):  # a row per candidate
        return stage(reduce(lambda a, b: a.unionByName(b), parts))


def judge_candidates(df: DataFrame, exprs: dict[str, str], y: str) -> tuple[DataFrame, DataFrame]:
    """`candidate_quality` and `score_candidates` without folds; one scan gives both for plain numbers and booleans."""
    types, _ = candidate_types(df, exprs)
    both = [n for n in exprs if isinstance(types.get(n), (*NUMERIC, T.BooleanType)) and not isinstance(types[n], T.DecimalType)]
    rest = {n: exprs[n] for n in exprs if n in types and n not in set(both)}
    if not both:
        return candidate_quality(df, exprs), score_candidates(df, exprs, y)
    row_hash = _row_hash(df)
    with compiled_methods(df.sparkSession):
        blocks = stage(_folded(df, exprs, types, both, row_hash, F.col(y).cast("double")))
        quality = stage(_quality(blocks, both))
    found = _merged_blocks(blocks.where("fold IS NOT NULL").select("fold", "i", F.col("m").alias("n"), *MOMENTS_OF))
    name = F.get(F.array(*[F.lit(n) for n in both]), F.col("i"))
    score = finite(F.when(F.abs("r") > 1, 1.0).otherwise(F.abs("r")), _double())
    scores = found.select(name.alias("candidate"), "fold", score.alias("score"), "rows")
    if rest:
        quality, scores = quality.unionByName(candidate_quality(df, rest)), scores.unionByName(score_candidates(df, rest, y))
    return quality, scores


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in df.columns if "map" not in df.schema[c].dataType.simpleString()])


def _folded(df: DataFrame, exprs: dict[str, str], types: dict, names: list[str], row_hash: Column, target: Column | None = None) -> DataFrame:
    """Rows of QUALITY: Spark works values and hashes out, a task folds their columns, a batch at a time. With a target, rows of JUDGED."""
    aim = [] if target is None else [target.alias("_y")]
    wide = df.select(row_hash.alias("_h"), *aim, *[finite(F.expr(exprs[n]), types[n]).alias(f"c{i}") for i, n in enumerate(names)])
    shown = [F.col(f"c{i}").cast("string") if isinstance(types[n], TIMES) else F.col(f"c{i}") for i, n in enumerate(names)]
    hashes = [F.xxhash64("_h", f"c{i}").alias(f"h{i}") for i in range(len(names))]
    rows = wide.select(*[c.alias(f"c{i}") for i, c in enumerate(shown)], *hashes, *["_y" for _ in aim])
    return rows.mapInArrow(_fold_values([isinstance(types[n], NUMERIC) for n in names], bool(aim)), JUDGED if aim else QUALITY)


def _quality(blocks: DataFrame, names: list[str]) -> DataFrame:
    """What the tasks say, a row per candidate in their order."""
    own = [F.sum(c).alias(c) for c in ("n", "there", "s", *(f"f_{at}" for at in PLACES))]
    ends = [F.least(F.min("a"), F.min("z")).alias("a"), F.greatest(F.max("a"), F.max("z")).alias("z")]
    every = blocks.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "candidate"))
    return every.join(blocks.groupBy("i").agg(*own, *ends), "i", "left").select(
        "candidate",
        F.coalesce(F.col("n") - F.col("there"), F.lit(0).cast("long")).alias("nulls"),
        F.coalesce(F.col("a") == F.col("z"), F.lit(True)).alias("constant"),
        F.when(F.col("there") > 0, F.try_divide("s", "there")).alias("mean"),
        F.when(F.col("n") > 0, _joined_parts("f")).alias("fingerprint"),
    )


def _fold_values(numeric: list[bool], scored: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns c0, c1, ..., their hashes h0, h1, ... and, if scored, a target in; one row of QUALITY or JUDGED per column out."""
    width = len(numeric)
    step = max(1, CELLS // max(1, width))
    block, merged = _moments()

    def text(v) -> str | None:
        return v if v is None or isinstance(v, str) else repr(v + 0.0) if isinstance(v, float) else str(v)  # -0.0 is 0.0

    def doubles(c: pa.Array) -> np.ndarray:
        return c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, there, total, hashes = 0, [0] * width, [0.0 if x else None for x in numeric], [0] * width
        low: list = [None] * width
        high: list = [None] * width
        sums: tuple | None = None
        for batch in batches:
            n += batch.num_rows
            for i in range(width):
                c, h = batch.column(i), batch.column(width + i).to_numpy()
                hashes[i] += int((h & 0xFFFFFFFF).sum()) + (int((h >> 32).sum()) << 32)
                some = len(c) - c.null_count
                if not some:
                    continue
                there[i] += some
                if numeric[i]:
                    total[i] += pc.sum(c.cast(pa.float64(), safe=False)).as_py()
                ends = pc.min_max(c)
                a, z = ends["min"].as_py(), ends["max"].as_py()
                low[i] = a if low[i] is None or a < low[i] else low[i]
                high[i] = z if high[i] is None or z > high[i] else high[i]
            if scored:
                aimed = batch.filter(batch.column(2 * width).is_valid()) if batch.column(2 * width).null_count else batch
                with np.errstate(all="ignore"):  # sums beyond the doubles are no score
                    for lo in range(0, aimed.num_rows, step):
                        part = aimed.slice(lo, step)
                        new = block(np.column_stack([doubles(part.column(i)) for i in range(width)]), doubles(part.column(2 * width)))
                        sums = merged(sums, new) if sums else new
        parts = [[h >> at if at == PLACES[-1] else (h >> at) & ((1 << PLACES[1]) - 1) for h in hashes] for at in PLACES]
        long, double = pa.int64(), pa.float64()
        typed = [(range(width), pa.int32()), ([n] * width, long), (there, long), (total, double), ([text(v) for v in low], pa.string()), ([text(v) for v in high], pa.string())]
        columns = [pa.array(c, t) for c, t in typed] + [pa.array(c, long) for c in parts]
        if scored:
            none = [np.zeros(width)] + [np.full(width, np.nan)] * 9
            columns += [pa.array([0 if sums else None] * width, pa.int32()), pa.array((sums or none)[0].astype(np.int64)), *[pa.array(c, double, from_pandas=True) for c in (sums or none)[1:]]]
        yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in (JUDGED if scored else QUALITY).split(", ")])

    return run


def _nested_quality(df: DataFrame, exprs: dict[str, str], types: dict, names: list[str], row_hash: Column) -> DataFrame:
    """The same for values that have no plain column, by Spark's aggregates."""
    wide = df.select(row_hash.alias("_h"), *[finite(F.expr(exprs[n]), types[n]).alias(f"c{i}") for i, n in enumerate(names)])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(names)):
        c = F.col(f"c{i}")
        aggs += [
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"z{i}"),
            *[F.sum(part).alias(f"f{i}_{at}") for at, part in _hash_parts(F.xxhash64("_h", c)).items()],
        ]
    rows = [
        F.struct(
            F.lit(n).alias("candidate"),
            (F.col("n") - F.col(f"n{i}")).alias("nulls"),
            F.coalesce(F.col(f"a{i}") == F.col(f"z{i}"), F.lit(True)).alias("constant"),
            F.lit(None).cast("double").alias("mean"),
            _joined_parts(f"f{i}").alias("fingerprint"),
        )
        for i, n in enumerate(names)
    ]
    return wide.agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
