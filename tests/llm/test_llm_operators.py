"""Operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from math import log2
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featureflow.llm import components, cotraining, lang_id, line_dedup, merkle, mixing, packing, pii, quality_rules, simhash, tokens, training_order
from featureflow.llm.common import documents, range_bucket, running
from featureflow.llm.queries import QUERIES
from featureflow.session import stage


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_ids(texts):
    return tokens.Encoder(tokens.default_paths()[0]).encode(texts)


# --- shared helpers -----------------------------------------------------------------------


def test_running_and_buckets(spark):
    rnd = random.Random(1)
    lists = [[rnd.randrange(-50, 50) for _ in range(n)] for n in (0, 1, 127, 128, 129, 700)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>")
    got = df.select("i", running(F.col("x")).alias("s"), running(F.col("x"), xor=True).alias("z")).orderBy("i").collect()
    for row, x in zip(got, lists, strict=True):
        assert row.s == np.cumsum(x).tolist() and row.z == np.bitwise_xor.accumulate(np.array(x, dtype=np.int64)).tolist()
    cuts = [-5, 0, 3, 3_000_000_000]
    values = [-9, -5, -1, 0, 2, 3, 4, 3_000_000_000, 1 << 40]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_bucket(F.col("v"), cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.v for c in cuts) for r in got)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)]
    nodes = {x for e in links for x in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == roots(nodes, links)


def test_encoder_equals_tokenizer(spark):
    texts = ["", "a b\nc", "a\n\nb", " a", "a  b", "x\0y \0z", "don't. it's!?", "é.\nñ,;", "tab\there", "<|endoftext|> x", "  x", "a.b.c. d", "15. 3.14,", "\n", "a\n", "😀, ok 😀."]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_paths()[0])
    whole.encode_special_tokens = True
    texts += ["a" * 5000, " " * 5000 + "x", "\u00a0" * 3000, "w" * 999 + " " * 999 + "z", "x\u2003 y\u2028z", "ẞ\u0301a ١٢٣ ⅷ"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for enc in (tokens.Encoder(tokens.default_paths()[0]), tokens.Encoder(*tokens.default_paths())):
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


# --- 1 mixing -----------------------------------------------------------------------------


def test_shortage_goes_to_siblings_before_ancestors(spark):
    docs = []
    for source, n in (("a1", 2), ("a2", 40), ("b1", 40)):
        docs += [(len(docs) + i, "w " * 10, "en", source) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(domains={"a": ("a1", "a2"), "b": ("b1",)}, weights={"domain": {"a": 1, "b": 1}, "source": {"a1": 1, "a2": 1}}, budget=400, max_epochs=2)
    got = mixing.mix_rows(df, mix)
    taken = {r.source: r.t for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert taken == {"a1": 40, "a2": 160, "b1": 200}  # a1 is short of 60 tokens: its sibling takes them, not b1
    assert {r.epoch for r in got.where("source = 'a1'").collect()} == {0, 1}
    wide = mixing.mix_rows(df, mixing.Mix(domains=mix.domains, weights=mix.weights, budget=2000, max_epochs=1))
    assert wide.count() == len(docs)  # no more than there is


# --- 2 fingerprints -----------------------------------------------------------------------


def test_next_over_ranges_and_located_edit(spark, sf):
    docs = documents(spark, sf)
    many = merkle.edit_likeness(docs, range_chars=20_000).orderBy("doc_id").collect()
    one = merkle.edit_likeness(docs).orderBy("doc_id").collect()
    assert many == one
    text = "\n".join(f"paragraph {i}, with words." for i in range(40))
    other = text.replace("paragraph 17,", "paragraph seventeen,")
    df = spark.createDataFrame([(text, other)], "a string, b string")
    prints = df.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = prints.select(merkle.differing_paragraphs(F.col("a"), F.col("b")).alias("d"), merkle.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert row.d == [17] and 0.9 < row.l < 1


# --- 3 language ---------------------------------------------------------------------------


def test_code_lengths_equal_plain_ppm(spark, sf):
    docs = documents(spark, sf)
    model = lang_id.learn(docs, rows=10, most=300)
    counts = defaultdict(Counter)
    for lang, tree in enumerate(model.trees):
        for s, b, n in zip(tree.state, tree.byte, tree.n, strict=True):
            context = int(tree.contexts[s]).to_bytes(8, "big")[8 - tree.sizes[s] :] if tree.sizes[s] else b""
            counts[lang, context][int(b)] += int(n)

    def price(lang, context, byte):
        while True:
            seen = counts.get((lang, context))
            if seen:
                t, d = sum(seen.values()), len(seen)
                if byte in seen:
                    return -log2(seen[byte] / (t + d))
                if not context:
                    return -log2(d / (t + d)) + 8
                return -log2(d / (t + d)) + price(lang, context[1:], byte)
            if not context:
                return 8.0
            context = context[1:]

    assert all(len(t.sizes) <= 300 for t in model.trees)
    raws = [r.text.encode()[:700] for r in docs.limit(6).collect()] + [b"", b"x", b"\xff\x00" * 300]
    got = lang_id.code_lengths(raws, model.order, lang_id.tables(model))
    for raw, row in zip(raws, got, strict=True):
        for lang in range(len(model.languages)):
            want = 0.0
            for i, byte in enumerate(raw):
                context = raw[max(0, i - model.order) : i]
                while (lang, context) not in counts:
                    context = context[1:]
                want += price(lang, context, byte)
            assert row[lang] == pytest.approx(want, rel=1e-4)


def test_a_hundred_languages(spark):
    """Made languages, each with its own order of the same letters: contexts don't run out as languages are added."""
    rnd = random.Random(3)
    follow = [{c: rnd.sample("abcdefghijklmnop ", 3) for c in "abcdefghijklmnop "} for _ in range(100)]

    def text(lang, n):
        out = ["a"]
        for _ in range(n):
            out.append(rnd.choice(follow[lang][out[-1]]))
        return "".join(out)

    rows = [(i, text(i % 100, 150), f"l{i % 100:02d}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(docs, rows=12, most=200)
    assert len(model.trees) == 100 and all(len(t.sizes) > 40 for t in model.trees)
    got = lang_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(lang_id.held_out()).collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_held_out_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


# --- 4 personal data ----------------------------------------------------------------------


def plain_spans(text):
    text, out = text or "", []
    luhn = lambda d: sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for i, (kind, pattern, ok) in enumerate(checks):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m[0])]
    return [s for *_, s in sorted(out)]


def test_base_spans_equal_plain_patterns(spark, sf):
    rnd = random.Random(3)
    texts = [r.text for r in documents(spark, sf).collect()]
    texts += ["".join(rnd.choice("ab.@+-_ 0123456789()%é\n") for _ in range(400)) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "a@b..c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "9" * 20_000, "a" * 20_000 + "@", "4111 1111-1111 1111", "+1 (234) 555-0100.", "x@" + "a." * 5_000 + "z", "+" * 3000 + "1", None]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert set(want) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in pii.KINDS]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [f"please write to mail: user{i}x{i * 7}@site{i % 9}.org today" for i in range(30)]
    rows += [f"server host {i % 250}.{i}.3.4 is up" for i in range(30)]
    rows += ["server host 300.1.3.4 is up", "mail: someone@localhost now", "version 3 of chapter 12"]
    got = pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), least_score=0.8).collect()
    added = {rows[r.doc_id]: r.spans for r in got if r.n_added}
    assert added == {"server host 300.1.3.4 is up": "ip:12:21"}


def test_contexts_discover_forms_of_no_base_pattern(spark):
    rows = [f"please write to mail: user{i}x{i * 7}@site{i % 9}.org today" for i in range(30)]
    rows += [f"the office phone is +49 30 {i + 100} {i * 37 + 1000} for all calls" for i in range(40)]
    rows += [f"server host {i % 250}.{i}.3.4 is up" for i in range(30)]
    unseen = {
        "please write to mail: someone@localhost today": "someone@localhost",
        "please write to mail: someone [at] example [dot] org today": "someone [at] example [dot] org",
        "the office phone is 030 1234 5678 for all calls": "030 1234 5678",
        "the office phone is (030) 1234-567 for all calls": "(030) 1234-567",
        "the office phone is 4930.1234.5678 for all calls": "4930.1234.5678",
        "server host 300.1.3.4 is up": "300.1.3.4",
    }
    other = ["in the year 1998 they met", "the sum is 12 345 678 of all", "mail: someone@intranet now", "the office phone is 12 years old"]
    texts = [*rows, *unseen, *other]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {}
    for r in got:
        if r.n_added:
            text = texts[r.doc_id]
            added[text] = [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(","))]
    assert added == {text: [string] for text, string in unseen.items()}


def test_hidden_seeds_come_back(spark):
    """Every fifth base string of the documents is hidden: contexts and shapes find them again, and nothing else."""
    docs = documents(spark, "/root/testdata/sf0.1")
    total = Counter()
    for fold in (0, 3):
        for r in pii.hidden_seeds(docs, fold).collect():
            total.update({("hidden", r.kind): r.hidden, ("found", r.kind): r.found, ("other", r.kind): r.other})
    hidden, found, other = (sum(n for (what, _), n in total.items() if what == w) for w in ("hidden", "found", "other"))
    assert hidden > 150 and found >= 0.9 * hidden and other <= 0.02 * found, total


# --- 5 packing ----------------------------------------------------------------------------


def test_pieces_cover_every_id_once(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf).select("doc_id", "text").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {d: [*x.tolist(), 1] for d, x in zip(texts, plain_ids(list(texts.values())), strict=True)}
    pieces = packing.pack(docs).collect()
    at = defaultdict(list)
    for p in pieces:
        raw = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4").tobytes()
        assert p.ids_crc32 == crc32(raw) and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id].append((p.start, p.length))
    for d, spans in at.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(ids[d])
    assert at.keys() == ids.keys()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length, p.loss_tokens))
    padding = 0
    for s in sequences.values():
        s.sort()
        size = sum(n for _, n, _ in s)
        assert s[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(s, s[1:])) and size <= 2048 and len(s) <= 64
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.01 * sum(map(len, ids.values()))


def test_short_texts_need_no_padding(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('some ', id % 7) AS text").coalesce(2)
    sizes = packing.pack(df).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    padding = sum(2048 - r.n for r in sizes if r.n & (r.n - 1))
    assert padding < 0.01 * sum(r.n for r in sizes) and max(r.k for r in sizes) <= 64


def test_limits_hold_together(spark):
    rnd = random.Random(4)
    talks = [(i, "question " * rnd.randrange(1, 60), "answer " * rnd.randrange(1, 90)) for i in range(400)]
    df = spark.createDataFrame(talks, "doc_id long, ask string, reply string").repartition(2)
    limits = packing.Limits(tokens=512, segments=5, loss=150, min_cut=8, pool=64)
    pieces = packing.pack(df, (("ask", False), ("reply", True)), limits).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for s in by.values():
        assert sum(p.length for p in s) <= 512 and len(s) <= 5 and sum(p.loss_tokens for p in s) <= 150
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(total[i] == len(x) + len(y) + 1 for (i, *_), x, y in zip(talks, plain_ids([t[1] for t in talks]), plain_ids([t[2] for t in talks]), strict=True))


# --- 6 rules ------------------------------------------------------------------------------


def test_repeated_words_by_brute_force():
    rnd = random.Random(5)
    for n in (0, 7, 8, 9, 20, 200):
        for _ in range(20):
            words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)]
            windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
            covered = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
            assert quality_rules.repeated_words(words) == len(covered)


def test_policies_and_ablations_from_bits(spark, sf):
    rows = stage(quality_rules.ledger(documents(spark, sf)))
    bits = [r.failure_bits for r in rows.collect()]
    for policy in quality_rules.POLICIES:
        m = quality_rules.mask(policy)
        assert quality_rules.apply_policy(rows, policy).where("kept").count() == sum(b & m == 0 for b in bits)
        for r in quality_rules.ablations(rows, policy).collect():
            own = quality_rules.bit(r.rule)
            assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & own > 0 for b in bits), sum(b & m == own for b in bits), sum(b & m & ~own == 0 for b in bits))


# --- 7 lines ------------------------------------------------------------------------------


def test_near_lines_by_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(6)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(9, 14))] for _ in range(12)]

    def edit(words):
        words = list(words)
        i, kind = rnd.randrange(len(words)), rnd.randrange(4)
        if kind == 0:
            words[i] = rnd.choice(vocabulary)
        elif kind == 1:
            del words[i]
        elif kind == 2:
            words.insert(i, rnd.choice(vocabulary))
        return words

    docs = [(d, "\n".join(" ".join(edit(edit(rnd.choice(base)))) for _ in range(6))) for d in range(60)]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 10 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    lines = [(d, i, x.split()) for d, t in docs for i, x in enumerate(t.split("\n"))]
    gone = defaultdict(list)
    for k, (d, i, words) in enumerate(lines):
        if any(near(words, w) for _, _, w in lines[:k]):
            gone[d].append(i)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.c0: r.gone for r in got if r.gone} == dict(gone)
    assert all(r.kept_text == "\n".join(x for i, x in enumerate(r.c1.split("\n")) if i not in r.gone) for r in got)


# --- 8 training order ---------------------------------------------------------------------


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        numbers = np.arange(n)
        at = training_order.slots(numbers, n)
        assert sorted(at.tolist()) == numbers.tolist()
        assert training_order.slots(at, n, back=True).tolist() == numbers.tolist()
    assert training_order.slots(np.arange(1000), 1000, key=1).tolist() != training_order.slots(np.arange(1000), 1000, key=2).tolist()


def test_shards_hold_the_sequences(spark, sf, tmp_path):
    docs = documents(spark, sf).repartition(3)
    got = training_order.materialise(docs, str(tmp_path / "shards"), length=256, per_shard=100).orderBy("number").collect()
    assert [r.number for r in got] == list(range(len(got))) and sorted(r.slot for r in got) == list(range(len(got)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {d: [*x.tolist(), 1] for d, x in zip(texts, plain_ids(list(texts.values())), strict=True)}
    for r in got:
        folder = tmp_path / "shards" / f"shard={r.shard}"
        raw = next(folder.glob("part-*")).read_bytes()
        assert r.shard == r.slot // 100 and r.byte_offset == (r.slot % 100) * training_order.stride(256)
        record = np.frombuffer(raw[r.byte_offset : r.byte_offset + 512], dtype="<u2").tolist()
        want = ids[r.doc_ids[0]][r.first_start :] + [x for d in r.doc_ids[1:] for x in ids[d]]
        assert record[: r.n_ids] == want[: r.n_ids] and set(record[r.n_ids :]) <= {1} and r.stored_crc32 == r.ids_crc32
    assert sum(r.n_ids for r in got) == sum(map(len, ids.values()))


def test_records_travel_in_small_batches(spark, odd, tmp_path, monkeypatch):
    rnd = np.random.default_rng(3)
    records = [rnd.bytes(4096) for _ in range(2000)]
    batches = [pa.record_batch([pa.array(range(lo, lo + 500)), pa.array(records[lo : lo + 500], pa.binary())], ["number", "record"]) for lo in range(0, 2000, 500)]
    sent = list(training_order._blocks(2000, 7, 100)(iter(batches)))
    largest = 100 * (4096 + 8) + 1000  # a block: the records of one shard
    assert len(sent) > 1 and max(b.nbytes for b in sent) <= training_order.SENT + largest
    got = {s: bytes(r) for b in training_order._records(iter(sent)) for s, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert got == dict(zip(training_order.slots(np.arange(2000), 2000, 7).tolist(), records, strict=True))
    seen, read = [], training_order.read_shards
    limits = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(x) for x in limits]
    monkeypatch.setattr(training_order, "read_shards", lambda *a: seen.append(spark.conf.get(limits[0])) or read(*a))
    out = training_order.materialise(odd, str(tmp_path / "shards"), length=64, per_shard=10)
    assert seen == ["1"] and [spark.conf.get(x) for x in limits] == before  # whole shards go to Python one by one
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "binaryFile" not in plan and out.where("stored_crc32 = ids_crc32").count() == out.count() > 100


# --- 9 classifier -------------------------------------------------------------------------


def test_quality_on_rows_set_aside(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_cotraining"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    aside = [r for r in got if crc32(str(r.doc_id).encode()) % 4 == 0]
    assert sum(r.kept == (r.quality == 1) for r in aside) / len(aside) > 0.9


def test_views_teach_each_other():
    rnd = np.random.default_rng(7)
    y = rnd.integers(0, 2, 460)
    text = rnd.normal(0, 0.3, (460, cotraining.N_TEXT)).astype(np.float32)
    meta = np.zeros((460, cotraining.N_META), dtype=np.float32)
    text[:, 0] += 3 * y
    meta[np.arange(460), np.where(rnd.random(460) < 0.95, y, 1 - y)] = 1
    few, aside = 60, np.arange(60) % 2 == 0
    model = cotraining.co_train(text[:few], meta[:few], y[:few], aside, cotraining.ArrayPool(text[few:], meta[few:]), cotraining.Settings(exchanged=40, least_sure=0.7))
    alone = cotraining.co_train(text[:few], meta[:few], y[:few], aside, None)
    right = lambda m: ((m.scores(text[few:], meta[few:])[2] >= 0.5) == y[few:]).mean()
    assert right(model) > 0.95 and right(model) >= right(alone) - 0.01


# --- 10 SimHash ---------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("task_rows", [8, 40, 1 << 17])
def test_trie_join_by_brute_force(spark, task_rows):
    rnd = random.Random(8)
    prints = {0, (1 << 64) - 1, 1, 6}
    for _ in range(25):
        center = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(center)
            for _ in range(rnd.randrange(3)):
                center ^= 1 << rnd.randrange(64)
    dense = rnd.getrandbits(64)
    prints |= {dense ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 64, 6), 2)}
    prints = sorted(prints)
    links = [(signed(a), signed(b)) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    want = roots([signed(p) for p in prints], links)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = [(r.u, r.v) for r in simhash.close_links(df, task_rows=task_rows).collect()]
    groups = lambda r: {frozenset(n for n in r if r[n] == k) for k in r.values()}
    assert groups(roots(want, found)) == groups(want)
    assert len(found) <= 4 * 8 * len(prints)


def plain_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_classes_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    docs |= {10_000: "", 10_001: None, 10_002: " ", 10_003: "One", 10_004: "one", 10_005: "É one", 10_006: "é one"}
    prints = {d: plain_print(t) for d, t in docs.items()}
    want = roots(docs, [(a, b) for a, b in combinations(docs, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (prints[d], want[d]) for d in docs}


def test_repeated_ids_keep_one_row_of_each_class(spark):
    rnd = random.Random(9)
    a, b, c = (" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 9) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, c), (3, a)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (3, c)])


# --- the pipeline -------------------------------------------------------------------------


def test_stages_by_brute_force(spark, sf):
    docs = documents(spark, sf)
    kept = stage(corpus_pipeline.quality(spark, docs, sf))
    whole = quality_rules.mask(quality_rules.CURRENT)
    judged = {r.doc_id: r.failure_bits & whole for r in quality_rules.ledger(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, b in judged.items() if not b)

    lines = stage(corpus_pipeline.lines(spark, kept, sf))
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    want = {d: text for d, n_gone, text in con.execute(f"SELECT doc_id, n_gone, kept_text FROM ({line_dedup.dedup_sql()})").fetchall() if not n_gone or re.search(r"[^\x20\x09-\x0D]", text)}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())

    single = stage(corpus_pipeline.near_duplicates(spark, lines, sf))
    prints = {d: plain_print(t) for d, t in want.items()}
    least = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(least.values()))

    mixed = stage(corpus_pipeline.mixture(spark, single, sf))
    con.register("documents", single.toPandas())
    want_mix = Counter(d for (d,) in con.execute(f"SELECT doc_id FROM ({mixing.mix_sql(mixing.PIPELINE)})").fetchall())
    assert Counter(r.doc_id for r in mixed.collect()) == want_mix
    assert mixed.columns == docs.columns

    pieces = corpus_pipeline.packed(spark, mixed, sf).collect()
    texts = [r.text for r in mixed.collect()]
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in plain_ids(texts))
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
