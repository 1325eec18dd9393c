"""Logs that grow, streams with timers and late rows, and a store whose jobs die."""

import os

import pytest
from pyspark.sql import functions as F

from featureflow.sources import logs as LOG
from featureflow.sources import tables as S
from featureflow.streaming import events as ST

BLOCK = '##NODE_CODE##\n{"code": "%s"}\n##END##\n'
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add(path, text):
    with open(path, "ab") as f:
        f.write(text.encode() if isinstance(text, str) else text)


def test_a_file_grows_between_batches_and_across_a_restart(spark, tmp_path):
    src, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()

    def batch():
        q = ST.write_append(LOG.stream_growing(spark, str(src)).select("file_path", "end", "position", "kind", "fields"), out, cp)
        q.awaitTermination()
        rows = spark.read.parquet(out).orderBy("file_path", "end", "position").collect()
        return [(os.path.basename(r.file_path), r.fields["code"]) for r in rows]

    second = BLOCK % "a2"
    add(src / "a.log", "noise\n" + BLOCK % "a1" + second[:20])  # the second block is cut
    assert batch() == [("a.log", "a1")]
    add(src / "a.log", second[20:30])
    assert batch() == [("a.log", "a1")]  # still open
    add(src / "a.log", second[30:-4])  # the mark itself is cut
    add(src / "b.log", BLOCK % "b1é" + "x" * 200_000 + "\n" + BLOCK % "b2")
    assert batch() == [("a.log", "a1"), ("b.log", "b1é"), ("b.log", "b2")]
    add(src / "a.log", second[-4:] + BLOCK % "a3" + "##END##\n" + BLOCK % "a4")
    add(src / "c.log", "")
    assert batch() == [("a.log", "a1"), ("a.log", "a2"), ("a.log", "a3"), ("a.log", "a4"), ("b.log", "b1é"), ("b.log", "b2")]
    assert len(batch()) == 6  # nothing new, nothing twice
    assert sorted((r.fields["code"]) for r in LOG.read_log_blocks(spark, str(src)).collect()) == ["a1", "a2", "a3", "a4", "b1é", "b2"]


def stream_of(spark, tmp_path, name, files):
    """A stream of one file per batch, in order."""
    folder = tmp_path / name
    folder.mkdir()
    schema = "run_id string, seq long, t long, type string, cost double"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part{i}"))
        for f in (folder / f"part{i}").glob("part-*.parquet"):
            target = folder / f"{i:03d}.parquet"
            f.rename(target)
            os.utime(target, (1_600_000_000 + i, 1_600_000_000 + i))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))
    return raw.select("run_id", "seq", F.timestamp_seconds("t").alias("ts"), "type", "cost")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def test_a_silent_run_times_out_and_its_state_goes(spark, tmp_path, rocks):
    files = [
        [("a", 1, 1000, "node_code", 1.0), ("b", 1, 1001, "node_code", 2.0), ("c", 2, 1002, "done", None), ("c", 1, 1001, "node_code", 5.0)],
        [("a", 3, 1012, "log", 0.5), ("a", 2, 1011, "node_code", 0.25)],  # out of order
        [("d", 1, 1200, "log", 1.0)],  # time goes on: b, c and a end
        [("d", 3, 1201, "log", 0.0)],  # rows are late by the watermark of the batch before
        [("b", 2, 1010, "done", 9.0), ("d", 2, 1199, "error", 1.0)],  # late: dropped; d is within the delay
        [("a", 9, 1400, "log", 7.0)],  # a speaks again, d ends
        [("z", 1, 2000, "log", 0.0)],
    ]
    stream = ST.run_status_until(stream_of(spark, tmp_path, "in", files), timeout_s=60, late_s=10)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    q = ST.write_updates(stream, out, cp)
    q.awaitTermination()
    progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    ended = {(r.run_id, r.cost_usd, r.events, r.nodes, r.status) for r in spark.read.parquet(out).where("ended").collect()}
    assert {("a", 1.75, 3, 2, "timeout"), ("b", 2.0, 1, 1, "timeout"), ("c", 5.0, 2, 1, "done"), ("d", 2.0, 3, 0, "error")} <= ended
    assert ("a", 7.0, 1, 0, "timeout") in ended and len(ended) == 5
    assert max(progress) <= 12 and progress[-1] <= 4  # values and timers of the open runs


def test_late_duplicates(spark, tmp_path):
    files = [
        [("a", 1, 1000, "x", 0.0), ("a", 2, 1005, "x", 0.0)],
        [("a", 3, 1003, "x", 0.0), ("b", 1, 1100, "x", 0.0)],  # a duplicate out of order, within the delay
        [("e", 1, 1101, "x", 0.0)],  # rows are late by the watermark of the batch before
        [("a", 4, 1001, "x", 0.0), ("c", 1, 1050, "x", 0.0), ("d", 1, 1095, "x", 0.0)],  # late rows, and one that is not
        [("a", 5, 1300, "x", 0.0)],  # the state of a is gone
    ]
    out = str(tmp_path / "out")
    q = ST.write_append(ST.dedupe_stream(stream_of(spark, tmp_path, "in", files), ["run_id", "type"], "20 seconds"), out, str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.run_id, r.seq) for r in spark.read.parquet(out).collect())
    rest = [("a", 5), ("b", 1), ("d", 1), ("e", 1)]
    assert got in ([("a", 1), *rest], [("a", 2), *rest])


class Lost(Exception):
    pass


@pytest.mark.parametrize("dies", ["write", "_write_text", "_rename", None])
def test_a_store_job_that_dies_changes_nothing(spark, tmp_path, monkeypatch, dies):
    path = str(tmp_path / "store")
    rows = lambda v: spark.createDataFrame([("001", "x", v), ("b", None, v)], "cache_key string, operation string, v int")
    S.write_results(rows(1), path)
    state = lambda: (
        sorted((r.cache_key, r.v) for r in S.read_results(spark, path).collect()),
        sorted((r.cache_key, r.version, r.v) for r in S.read_archive(spark, path).collect()),
    )
    assert state() == ([("001", 1), ("b", 1)], [])

    def die(*a, **k):
        raise Lost

    for job in (lambda: S.write_results(rows(2).where("cache_key = '001'"), path), lambda: S.archive_results(spark, path, "001")):
        before = state()
        if dies:
            with monkeypatch.context() as m:
                m.setattr(S, "_commit" if dies == "write" else dies, die)
                with pytest.raises(Lost):
                    job()
            assert state() == before
        job()
        assert state() != before
    assert state() == ([("b", 1)], [("001", 1, 2)])
    assert S.archive_results(spark, path, "001") == 1  # repeated: nothing live is left to archive
    S.write_results(rows(3).where("cache_key = '001'"), path)
    assert S.archive_results(spark, path, "001") == 2
    last = ([("b", 1)], [("001", 1, 2), ("001", 2, 3)])
    assert state() == last
    S.clean_results(spark, path)
    assert state() == last


def test_two_writers_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    one = lambda k: spark.createDataFrame([(k, "x", 1)], "cache_key string, operation string, v int")
    S.write_results(one("a"), path)
    rename, other = S._rename, []

    def slow(spark, source, target):
        if not other:  # another writer commits first
            other.append(1)
            S.write_results(one("b"), path)
        return rename(spark, source, target)

    monkeypatch.setattr(S, "_rename", slow)
    S.write_results(one("c"), path)
    assert sorted(r.cache_key for r in S.list_keys(spark, path).collect()) == ["a", "b", "c"]
