"""Quality classifier by co-training of a text view and a page-metadata view.

Each view has its own logistic regression. Both start from the labelled sample; in
every round one Spark pass scores all unlabelled rows with both views, and those a view is surest of, in
the class proportions of the labelled sample, join the training rows of the other view.
At the end both views are calibrated (Platt scaling) on labelled rows that were never
trained on, and the two calibrated log odds are combined by a third regression on
the same rows. All documents are scored in one pass over texts and metadata.

What the models are fitted on is bounded by `Settings.labelled` (rows in hash order) and by
`Settings.exchanged` rows per view and round; rounds and scoring read every row. Features
are made once and staged with 16 bits each.

Defined results: NULL text, source, lang or n_chars are feature values of their
own; without labels of both classes every score is the smoothed share of good labels
(one half without any label); rows that repeat a doc_id are scored one by one, and the one with the
least hash of its values is learned from; rows without a doc_id are unlabelled; labels that
repeat a doc_id count once, the lower one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import staged_side, with_package
from featureflow.operators.windows import top_per_group
from featureflow.session import remove_path, stage, staged_path, tidy

_CLASSES = np.zeros(256, dtype=np.int64)  # other bytes: 0
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!"), 1):
    _CLASSES[list(_chars)] = _k
N_TEXT = 256 + 64 + 6
N_META = 64 + 16 + 24


@dataclass(frozen=True)
class Settings:
    """Bounds of the samples and the course of the rounds."""

    labelled: int = 4000
    rounds: int = 4
    exchanged: int = 200
    least_sure: float = 0.9
    penalty: float = 1.0


def text_features(text: str | None) -> np.ndarray:
    """Byte shares, shares of neighbouring character classes, and word statistics."""
    out = np.zeros(N_TEXT, dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        out[-1] = 1
        return out
    data = np.frombuffer(raw, dtype=np.uint8)
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
    kinds = _CLASSES[data]
    if len(data) > 1:
        out[256:320] = np.sqrt(np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64) / (len(data) - 1))
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(len(words), 1)
    out[320:325] = (len(set(words)) / n, len(set(lines)) / len(lines), min(len(raw) / n, 40) / 40, np.log1p(n) / 10, np.log1p(n / len(lines)) / 10)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One place each for the hashed source, the hashed language and the order of the length."""
    out = np.zeros(N_META, dtype=np.float32)
    out[crc32((source or "\0").encode()) % 64] = 1
    out[64 + crc32((lang or "\0").encode()) % 16] = 1
    out[80 + (0 if n_chars is None else min(23, 1 + max(int(n_chars), 0).bit_length()))] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with an L2 penalty, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    """Weights of both views, their calibrations (slope, shift) and the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    mix: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the two views and of their combination."""
        a = self.text_scale[0] * log_odds(text, self.text) + self.text_scale[1]
        b = self.meta_scale[0] * log_odds(meta, self.meta) + self.meta_scale[1]
        both = log_odds(np.stack([a, b], axis=1), self.mix)
        return sigmoid(a), sigmoid(b), sigmoid(both)


#: Row numbers, both feature blocks and labels of the rows that a view is surest of.
Surest = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def wanted(share: float, s: Settings) -> dict[int, int]:
    """How many good and bad rows a view hands over."""
    good = max(1, round(s.exchanged * share))
    return {1: good, 0: max(1, s.exchanged - good)}


class ArrayPool:
    """Unlabelled rows as arrays."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.text, self.meta = text, meta

    def surest(self, text_w: np.ndarray, meta_w: np.ndarray, to_text: set[int], to_meta: set[int], counts: dict[int, int], least: float) -> tuple[Surest, Surest]:
        """What the text view hands to the other and the other way round; rows already handed over stay out."""
        out = []
        for z, taken in ((log_odds(self.text, text_w), to_meta), (log_odds(self.meta, meta_w), to_text)):
            free = np.ones(len(z), dtype=bool)
            free[list(taken)] = False
            found, labels = [], []
            for label, count in counts.items():
                sure = z if label else -z
                order = np.argsort(np.where(free, -sure, np.inf), kind="stable")[:count]
                order = order[free[order] & (sure[order] >= _logit(least))]
                found.append(order)
                labels.append(np.full(len(order), label))
            at = np.concatenate(found)
            out.append((at, self.text[at], self.meta[at], np.concatenate(labels)))
        return out[0], out[1]


class TablePool:
    """Rows as a staged table (row, doc_id, h, x); a pass over it scores all with both views, `known` (doc_id) stays out."""

    def __init__(self, rows: DataFrame, known: DataFrame):
        self.rows, self.known = rows, known

    def surest(self, text_w: np.ndarray, meta_w: np.ndarray, to_text: set[int], to_meta: set[int], counts: dict[int, int], least: float) -> tuple[Surest, Surest]:
        bound = _logit(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unpacked(batch.column(3).to_pylist())
                z = np.stack([log_odds(x[:, :N_TEXT], text_w), log_odds(x[:, N_TEXT:], meta_w)])
                for view in (0, 1):
                    sure = np.abs(z[view]) >= bound
                    at = pa.array(np.flatnonzero(sure))
                    columns = [*(batch.column(i).take(at) for i in range(3)), pa.array(np.full(len(at), view, np.int32)), pa.array((z[view][sure] > 0).astype(np.int32)), pa.array(-np.abs(z[view][sure]))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", "view", "label", "doubt"])

        spark = self.rows.sparkSession
        sure = with_package(self.rows).mapInArrow(run, "row long, doc_id long, h long, view int, label int, doubt double")
        sure = sure.join(self.known, "doc_id", "left_anti")
        handed = [(r, 0) for r in to_meta] + [(r, 1) for r in to_text]
        if handed:  # at most `exchanged` rows per view and round
            sure = sure.join(F.broadcast(spark.createDataFrame(handed, "row long, view int")), ["row", "view"], "left_anti")
        # of equal rows one is handed over
        sure = stage(sure.groupBy("view", "label", "h").agg(F.min("doubt").alias("doubt"), F.min("row").alias("row")))
        most = F.when(F.col("label") == 1, F.lit(counts[1])).otherwise(F.lit(counts[0]))
        best = top_per_group(sure, ["view", "label"], most, ["doubt", "h", "row"]).select("row", "view", "label")
        found = self.rows.join(F.broadcast(best), "row").select("row", "view", "label", "h", "x").toPandas().sort_values(["view", "label", "h", "row"])
        remove_path(spark, staged_path(sure))
        out = []
        for view in (0, 1):
            own = found[found["view"] == view]
            x = _unpacked(own["x"])
            out.append((own["row"].to_numpy(np.int64), x[:, :N_TEXT], x[:, N_TEXT:], own["label"].to_numpy(np.int64)))
        return out[0], out[1]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, pool: ArrayPool | TablePool | None, s: Settings = Settings()) -> Model:
    """The model of a labelled sample (`aside`: rows for calibration) and a pool of unlabelled rows."""
    learn = ~aside
    if min(len(np.unique(y[learn])), len(np.unique(y[aside]))) < 2:
        prior = _logit((y.sum() + 1) / (len(y) + 2))
        flat = lambda n: np.append(np.zeros(n), prior)
        return Model(flat(N_TEXT), flat(N_META))
    counts = wanted(float(y[learn].mean()), s)
    tx, ty, mx, my = text[learn], y[learn], meta[learn], y[learn]
    to_text, to_meta = set(), set()
    for _ in range(s.rounds if pool else 0):
        text_w, meta_w = fit(tx, ty, s.penalty), fit(mx, my, s.penalty)
        by_text, by_meta = pool.surest(text_w, meta_w, to_text, to_meta, counts, s.least_sure)
        to_meta.update(by_text[0].tolist())
        to_text.update(by_meta[0].tolist())
        mx, my = np.vstack([mx, by_text[2]]), np.concatenate([my, by_text[3]])
        tx, ty = np.vstack([tx, by_meta[1]]), np.concatenate([ty, by_meta[3]])
        if not len(by_text[0]) + len(by_meta[0]):
            break
    text_w, meta_w = fit(tx, ty, s.penalty), fit(mx, my, s.penalty)
    scaled = []
    for x, w in ((text[aside], text_w), (meta[aside], meta_w)):
        scaled.append(tuple(fit(log_odds(x, w)[:, None], y[aside], 0.01)))
    z = [a * log_odds(x, w) + b for (a, b), (x, w) in zip(scaled, ((text[aside], text_w), (meta[aside], meta_w)), strict=True)]
    mix = fit(np.stack(z, axis=1), y[aside], 0.01)
    return Model(text_w, meta_w, scaled[0], scaled[1], mix)


def _narrow(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def _picked(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of the ids in hash order, without a sort of all."""
    n = ids.count()
    near = ids.withColumn("h", F.xxhash64(F.lit(3), "doc_id")).where((F.col("h") / 2.0**64 + 0.5) * n < 1.5 * rows + 50)
    return near.orderBy("h", "doc_id").limit(rows).drop("h")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, source, lang, n_chars = (c.to_pylist() for c in batch.columns[2:])
        values = [np.concatenate([text_features(t), meta_features(*m)]).astype(np.float16).tobytes() for t, m in zip(text, zip(source, lang, n_chars, strict=True), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["doc_id", "h", "x"])


def _unpacked(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(-1, N_TEXT + N_META).astype(np.float32)


@tidy
def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Co-trains on a bounded labelled sample and all other rows of `docs`; `labels` has doc_id and quality (0 or 1)."""
    rows = _narrow(docs)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("long").alias("label"))
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").distinct()
    marked = staged_side(_picked(ids.join(known, "doc_id"), s.labelled))
    h = F.xxhash64("text", "source", "lang", "n_chars").alias("h")
    made = with_package(rows.select("doc_id", h, "text", "source", "lang", "n_chars")).mapInArrow(_featured, "doc_id long, h long, x binary")
    pool = stage(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "x"))
    found = pool.join(marked, "doc_id").select("doc_id", "h", "label", "x").toPandas()
    found = found.sort_values(["doc_id", "h"]).drop_duplicates("doc_id")
    x, y = _unpacked(found["x"]), found["label"].to_numpy(np.int64)
    aside = np.array([crc32(str(i).encode()) % 4 == 0 for i in found["doc_id"]], dtype=bool)
    model = co_train(x[:, :N_TEXT], x[:, N_TEXT:], y, aside, TablePool(pool, staged_side(known.select("doc_id"))), s)
    remove_path(docs.sparkSession, staged_path(pool))
    return model


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept (score at least `least`) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, text, source, lang, n_chars = (c.to_pylist() for c in part.columns)
                t = np.stack([text_features(x) for x in text])
                m = np.stack([meta_features(*x) for x in zip(source, lang, n_chars, strict=True)])
                data = [pa.array(ids, pa.int64()), *(pa.array(p) for p in model.scores(t, m))]
                yield pa.RecordBatch.from_arrays(data, ["doc_id", "p_text", "p_meta", "score"])

    found = with_package(_narrow(docs)).mapInArrow(run, "doc_id long, p_text double, p_meta double, score double")
    return found.withColumn("kept", F.col("score") >= least)
