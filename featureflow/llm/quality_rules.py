"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document. The ledger keeps one bit per failed
rule beside the measurements; a policy is a named, versioned set of rules, so
that another policy or an ablation needs the bits only, never the texts.

Defined results: a NULL text counts as empty (0 words, fails `few_words`); ties do
not arise; repeated rows are judged one by one; an empty table gives an empty
ledger; other columns of the input are neither read nor required.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import WHITE, with_package

WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

_WHITE = WHITE.encode()
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """One rule: its bit is set where `fails` (SQL over the measurements) holds."""

    name: str
    fails: str


#: The place of a rule is its bit; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("upper_case", "n_upper > n_lower AND n_upper > n_words"),
    Rule("marks", "5 * n_marks > n_words"),
)

BASE = ("few_words", "repeated_windows")

#: Versioned policies: a document goes if it fails any rule of its policy.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
    "v3": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "upper_case", "marks"),
}
CURRENT = "v3"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint64)
    if len(known) == len(words):
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        spread = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        for k in range(window):
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + spread[k : k + n]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(twice).tolist():  # equal hashes are confirmed on the words themselves
        seen.setdefault(codes[i : i + window].tobytes(), []).append(i)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of `MEASURES`."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    white = len(raw) - len(raw.translate(None, _WHITE))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text or "") - white,
        count(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        count(_UPPER),
        count(_LOWER),
        count(b"!"),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
        data = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(data, ["doc_id", *MEASURES])


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def failure_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(0) for i, r in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failure_bits`, one row per row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = with_package(texts).mapInArrow(_measure_batches, LEDGER_SCHEMA)
    return measured.withColumn("failure_bits", failure_bits())


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds `kept`: no rule of the policy failed. Reads nothing but the bits."""
    return rows.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail it alone, and stay if it is dropped.

    Counts rest on one aggregation by distinct bit pattern (at most 2^rules rows).
    """
    whole = mask(policy)
    patterns = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit(name)).alias("bit")) for name in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of `docs`, all columns, that no rule of the policy rejects.

    The texts pass through the same task that measures them, so nothing is joined.
    """
    whole, names = mask(policy), docs.columns
    at = names.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(at).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
            data = [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(data, [*(f"c{i}" for i in range(len(names))), *MEASURES])

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)), *(f"{m} long" for m in MEASURES)])
    out = with_package(plain).mapInArrow(kept, schema).where(failure_bits().bitwiseAND(F.lit(whole)) == 0)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
