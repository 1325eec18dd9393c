"""Filter audit, packing by swaps and resampling against brute force."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from math import floor, log
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.llm import filter_audit, line_dedup, resampling, swap_packing, tokens
from featureflow.llm.common import documents
from featureflow.session import stage

# --- 11 filter audit ----------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    rows = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        fails = set()
        if len(w) < 100:
            fails.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if d is not None and least[t] < d:
            fails.add("E")
        rows[lang or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, own in rows.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                n = Counter()
                for fails, g, bad in own:
                    out_before, here = bool(fails & set(order[:i])), x in fails
                    n["kept"] += not out_before and not here
                    n["removed"] += here and not out_before
                    n["redundant"] += here and out_before
                    n["unique_fails"] += fails == {x}
                    n["good_lost"] += here and not out_before and g
                    n["toxic_lost"] += here and not out_before and bad
                total[x] += n["removed"]
                out[part, order, i + 1] = [n[c] for c in filter_audit.COUNTS]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def test_audit_by_brute_force(spark):
    rnd = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "x|y", "zeta\u00a0eta", "one", "two"]
    texts = [rnd.choice(["", None, " \t\x0b", "A" * 30, "é" * 9 + "A"])] + [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 99, 100, 120]))) for _ in range(14)]
    texts += [" ".join(f"w{i}" for i in range(130)), " ".join(f"W{i % 90}" for i in range(112))]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(70)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): [*(r[c] for c in filter_audit.COUNTS), r.shapley] for r in got.collect()} == want


def test_fields_take_large_sums_without_overflow():
    integers = filter_audit.packed()
    n = (1 << (8 * filter_audit.FIELD_BYTES)) - 1
    counts = filter_audit.unpacked(n * integers[31, True, True])
    assert counts.min() == 0 and counts.max() == n
    assert (counts[:, 0, filter_audit.COUNTS.index("removed")] == n).all() and (counts[:, 1:, filter_audit.COUNTS.index("redundant")] == n).all()
    total = sum(k * v for k, v in enumerate(integers.values()))
    assert (filter_audit.unpacked(total) == sum(k * filter_audit.unpacked(v) for k, v in enumerate(integers.values()))).all()


def test_sums_leave_a_task_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_SUMS", 2)
    docs = [(i, f"text {i}", f"l{i % 7}") for i in range(70)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.part: r.removed for r in got.where("filter_order = 'ABCDE' AND step = 1").collect()} == {f"l{i}": 10 for i in range(7)}


# --- 7 lines, with all sides shuffled -------------------------------------------------------


def test_line_dedup_without_broadcasts(spark, sf, monkeypatch):
    """Sides that are too large to be sent are shuffled: the same lines go."""
    docs = documents(spark, sf)
    want = {r.c0: (r.gone, r.kept_text) for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    monkeypatch.setattr(line_dedup, "staged_side", stage)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = line_dedup.dedup_lines(docs.select("doc_id", "text"))
        assert {r.c0: (r.gone, r.kept_text) for r in got.collect()} == want and any(g for g, _ in want.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_short_repeats_go_and_leave_no_fragments(spark):
    line = "one line of ten words that many of the documents share"
    rows = [(1, f"Title\n{line}\n\nend"), (2, f"Title\n{line}\n\nend"), (3, "Title"), (4, "\n \n"), (5, None), (6, "Title\nown words here")]
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 4: "\n \n", 5: None, 6: "own words here"}


# --- 12 packing by swaps ------------------------------------------------------------------


def fewest_bins(lengths, room):
    """The least number of bins, by trying all placements."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        seen = set()
        for b, f in enumerate(fills):
            if f + lengths[i] <= room and f not in seen:
                seen.add(f)
                fills[b] += lengths[i]
                place(i + 1, fills)
                fills[b] -= lengths[i]
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def squared(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_search_against_the_fewest_bins():
    rnd = random.Random(12)
    more = 0
    for _ in range(150):
        room = rnd.choice([20, 50])
        lengths = [rnd.randint(1, room - 1) for _ in range(rnd.randint(1, 11))]
        bins = swap_packing.pack_lengths(lengths, room)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= room for b in bins)
        first = swap_packing.best_fit(lengths, room)
        assert len(bins) <= len(first) and squared(bins, lengths) >= squared(first, lengths)
        more += len(bins) - fewest_bins(lengths, room)
    assert more <= 3


@pytest.mark.parametrize("lengths, room", [([6, 6, 4, 4, 4, 3, 3], 15), ([7, 5, 5, 4, 4, 3, 2], 10), ([400 + 7 * i % 200 for i in range(900)], 2048)])
def test_swaps_empty_bins_that_best_fit_needs(lengths, room):
    assert len(swap_packing.pack_lengths(lengths, room)) < len(swap_packing.best_fit(lengths, room)) or len(swap_packing.best_fit(lengths, room)) == -(-sum(lengths) // room)


def test_pieces_of_swap_packing(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, "word " * 5000), (-2, "word " * 2047)], "doc_id long, text string"))
    rows = swap_packing.pack(docs, block=100).collect()
    plain = docs.collect()
    encoded = tokens.Encoder(tokens.default_paths()[0]).encode([r.text for r in plain])
    ids = {r.doc_id: np.append(x, 0).astype("<u4") for r, x in zip(plain, encoded, strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids[d]) and all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 2048
    total = sum(len(x) for x in ids.values())
    assert len(by_sequence) <= -(-total // 2048) + 4


def test_packing_wastes_little_of_its_sequences(spark, sf):
    rows = swap_packing.pack(documents(spark, sf))
    got = rows.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert got.s <= -(-got.n // 2048) + 1


# --- 13 resampling ------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("draw", [resampling.Draw(), resampling.Draw(least_gram=1, most_gram=2, buckets=70_000, least_words=2, percent=50, seed=7)])
def test_resampling_by_brute_force(spark, draw):
    rnd = random.Random(13)
    vocabulary = ["Ära", "one", "TWO", "x9", "straße", "日本", "zero", "nine", "İx", "a-b"]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60)))) for i in rnd.sample(range(-(10**12), 10**12), 150)] + [(5, None), (6, "")]
    target = [(" ".join(rnd.choice(vocabulary[:4]) for _ in range(30)),) for _ in range(9)] + [(None,)]

    def grams(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(draw.least_gram, draw.most_gram + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: crc32(g.encode()) % draw.buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t))
    t = Counter(bucket(g) for (x,) in target for g in grams(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (total_s + draw.buckets) / ((s[b] + 1) * (total_t + draw.buckets))))
    want = {}
    for d, x in docs:
        weight = sum(gain(bucket(g)) for g in grams(x))
        h = int(sha256(f"{draw.seed}:{d}".encode()).hexdigest()[:8], 16)
        want[d] = [len(grams(x)), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d, x in docs if len(plain_words(x)) >= draw.least_words), key=lambda d: (-want[d][2], d))
    for i, d in enumerate(able[: draw.percent * len(able) // 100]):
        want[d][3] = i + 1
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(target, "text string"), draw).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("bits", [3, 16])
def test_radix_ranks_of_all_longs(spark, monkeypatch, bits):
    monkeypatch.setattr(resampling, "BLOCK_BITS", (bits, bits))
    rnd = random.Random(bits)
    edge = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    rows = [(rnd.choice([*edge, *range(4)]), rnd.choice([*edge, rnd.randrange(-(1 << 40), 1 << 40)]), i) for i in range(300)]
    df = stage(spark.createDataFrame(rows, "a long, b long, i int").repartition(6))
    got = sorted(resampling.radix_ranks(df, ["a", "b"]).collect(), key=lambda r: r.number)
    assert [r.number for r in got] == list(range(300)) and [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in rows)
    assert {r.i for r in got} == set(range(300))


def test_a_pass_is_stable(spark):
    df = stage(spark.range(5000).select(F.lit(7).cast("long").alias("k"), "id").coalesce(1))
    got = resampling.radix_ranks(df, ["k"]).collect()
    assert all(r.number == r.id for r in got)

