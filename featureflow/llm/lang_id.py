"""Language identification by prediction by partial matching over bytes.

One context tree per language, learned from a bounded sample of labelled rows and then
frozen. A byte costs -log2 of its probability after the longest context (up to
`order` bytes) that the tree knows: n / (t + d) if it was seen there n times, else
the escape d / (t + d) and the price after the context without its first byte, where t
counts the bytes seen after the context and d the different ones; below the empty
context all 256 bytes are equally likely. A context that a language hasn't seen costs
nothing and is left for the next shorter one. The language with the shortest code for
the whole text wins; the score is its share among 2^-length of all languages.

Each language keeps its own most frequent contexts, the same number whatever other
languages there are. Its tree is an automaton: states are the contexts, and a table holds the
price of every byte in every state. Bytes that a language hasn't seen share one column,
so that the table grows with the contexts and the bytes of the language only. A text is
cut into segments that run side by side; since a state depends on the last `order` bytes
only, a segment started that far ahead gives exactly the lengths of an uncut run.

Defined results: `und` and 0.0 for a NULL text, a text without a letter, and where
nothing could be learned; equal lengths go to the first language by name; rows with
repeated doc_id are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.llm.common import staged_side, with_package
from featureflow.session import tidy

#: Labelled rows per language that a model is learned from.
SAMPLE_ROWS = 400
ORDER = 4
#: Contexts kept per language (the most frequent; every prefix and suffix of one is kept too).
MOST_CONTEXTS = 8192
UNKNOWN = "und"

_SEGMENT = 256


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and text of at most `rows` labelled, not held-out rows per language, by hash order."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    keys = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a cut on the hash leaves about 1.5 times the rows wanted, which are then ranked
    near = keys.join(staged_side(counts), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") < 1.5 * rows + 50)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = near.withColumn("nth", nth).where(F.col("nth") <= rows).select(F.col("doc_id").alias("pick"), F.col("lang").alias("pick_lang")).distinct()
    texts = known.join(staged_side(ids), (known["doc_id"] == F.col("pick")) & (known["lang"] == F.col("pick_lang")), "left_semi")
    return texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, size, gram, n: how often each run of 1 to order + 1 bytes occurs (big-endian number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sizes, grams, counts = [], [], [], []
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, raws in by.items():
                for size in range(1, order + 2):
                    codes = np.concatenate([_grams(raw, size) for raw in raws])
                    values, n = np.unique(codes, return_counts=True)
                    langs += [lang] * len(values)
                    sizes.append(np.full(len(values), size))
                    grams.append(values.astype(np.int64))
                    counts.append(n)
            if langs:
                arrays = [pa.array(langs), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, grams, counts))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "size", "gram", "n"])

    counted = with_package(texts).mapInArrow(run, "lang string, size long, gram long, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _grams(raw: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data) - size + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        code = (code << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return code


@dataclass(frozen=True)
class Tree:
    """Frozen statistics of a language: the size and number of each kept context, and a count for each (context, byte) seen."""

    sizes: np.ndarray
    contexts: np.ndarray
    state: np.ndarray
    byte: np.ndarray
    n: np.ndarray


@dataclass(frozen=True)
class Model:
    name: str
    languages: tuple[str, ...]
    order: int
    trees: tuple[Tree, ...]


@tidy
def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER, most: int = MOST_CONTEXTS) -> Model:
    """The model of a sample; what comes to the driver is bounded by the sample."""
    found = gram_counts(sample(docs, rows), order).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    trees = tuple(_tree(*(own[c].to_numpy(np.int64) for c in ("size", "gram", "n")), most) for own in (found[found["lang"] == x] for x in languages))
    name = sha256(pickle.dumps((languages, order, trees))).hexdigest()
    return Model(name, languages, order, trees)


def _tree(size: np.ndarray, gram: np.ndarray, n: np.ndarray, most: int) -> Tree:
    keys = np.stack([size - 1, gram >> 8], axis=1)  # the context of each run of bytes
    contexts, at = np.unique(keys, axis=0, return_inverse=True)
    at = at.reshape(-1)
    total = np.bincount(at, weights=n, minlength=len(contexts))
    keep = np.sort(np.lexsort((contexts[:, 1], contexts[:, 0], -total))[:most])
    number = np.full(len(contexts), -1)
    number[keep] = np.arange(len(keep))
    known = number[at] >= 0
    place = np.lexsort((gram[known], number[at][known]))  # rows come from a shuffle in any order
    return Tree(contexts[keep, 0], contexts[keep, 1], number[at][known][place], (gram[known] & 255)[place], n[known][place])


@dataclass(frozen=True)
class Table:
    """column[byte]; at state * width + column, the next state and the price in bits."""

    column: np.ndarray
    width: int
    step: np.ndarray
    bits: np.ndarray


def tables(model: Model) -> list[Table]:
    return [_table(t, model.order) for t in model.trees]


def _table(tree: Tree, order: int) -> Table:
    seen = np.unique(tree.byte)
    column = np.full(256, len(seen), dtype=np.int64)  # the last column is for bytes never seen
    column[seen] = np.arange(len(seen))
    n_states, width = len(tree.sizes), len(seen) + 1
    number = {(int(s), int(c)): i for i, (s, c) in enumerate(zip(tree.sizes, tree.contexts, strict=True))}
    counts = np.zeros((n_states, width), dtype=np.float32)
    counts[tree.state, column[tree.byte]] = tree.n
    step = np.zeros((n_states, width), dtype=np.int32)
    bits = np.full((n_states, width), 8.0, dtype=np.float32)
    for i in np.argsort(tree.sizes, kind="stable").tolist():  # shorter contexts first
        size, code = int(tree.sizes[i]), int(tree.contexts[i])
        if size:
            shorter = number[size - 1, code & ((1 << (8 * (size - 1))) - 1)]
            step[i], below = step[shorter], bits[shorter]
        else:
            below = bits[i].copy()
        t, d = counts[i].sum(), np.count_nonzero(counts[i])
        bits[i] = below - np.log2(d / (t + d))
        here = np.flatnonzero(counts[i])
        bits[i, here] = -np.log2(counts[i, here] / (t + d))
        if size < order:
            for k in here.tolist():
                longer = number.get((size + 1, (code << 8) | int(seen[k])))
                if longer is not None:
                    step[i, k] = longer
    return Table(column, width, step.reshape(-1), bits.reshape(-1))


@lru_cache(maxsize=2)
def _cached(name: str, shared: Broadcast) -> list[Table]:
    return tables(shared.value)


def code_lengths(raws: list[bytes], order: int, languages: list[Table]) -> np.ndarray:
    """Bits of every text in every language."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    out = np.zeros((len(raws), len(languages)))
    if not sizes.sum():
        return out
    data = np.frombuffer(b"\0" * order + b"".join(raws) + b"\0" * _SEGMENT, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + order
    pieces = -(-sizes // _SEGMENT)
    owner = np.repeat(np.arange(len(raws)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + nth * _SEGMENT
    length = np.minimum(sizes[owner] - nth * _SEGMENT, _SEGMENT)
    rank = np.argsort(-length, kind="stable")
    owner, begin, length, first = owner[rank], begin[rank], length[rank], nth[rank] == 0
    live = np.searchsorted(-length, -np.arange(_SEGMENT), side="left")  # segments longer than t, for each t
    for i, table in enumerate(languages):
        columns = table.column[data]
        total = np.zeros(len(owner))
        state = np.zeros(len(owner), dtype=np.int64)
        for t in range(-order, 0):  # the bytes before a segment set its state; a text's first segment starts with none
            state = np.where(first, 0, table.step[state * table.width + columns[begin + t]])
        for t in range(int(length[0])):
            k = int(live[t])
            at = state[:k] * table.width + columns[begin[:k] + t]
            total[:k] += table.bits[at]
            state[:k] = table.step[at]
        out[:, i] = np.bincount(owner, weights=total, minlength=len(raws))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row of `docs`; only the texts are looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages, order, name = model.languages, model.order, model.name

    def some(texts: list[str | None], letters: list[bool], trees: list[Table]) -> list[tuple]:
        raws = [t.encode() if ok else b"" for t, ok in zip(texts, letters, strict=True)]
        lengths = code_lengths(raws, order, trees)
        best = lengths.argmin(axis=1)
        share = 1.0 / np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000.0)).sum(axis=1)
        rows = zip(letters, best.tolist(), share.tolist(), lengths.min(axis=1).tolist(), raws, strict=True)
        return [(languages[b], s, n / len(r)) if ok else (UNKNOWN, 0.0, None) for ok, b, s, n, r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _cached(name, shared) if languages else []
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_pylist()
            texts, rows, lo = text.to_pylist(), [], 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < 2_000_000):
                    chars += len(texts[hi] or "")
                    hi += 1
                if languages:
                    rows += some(texts[lo:hi], letters[lo:hi], trees)
                else:
                    rows += [(UNKNOWN, 0.0, None)] * (hi - lo)
                lo = hi
            found = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            data = [batch.column(0), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(data, ["doc_id", "lang_pred", "score", "bits_per_byte"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_package(texts).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
