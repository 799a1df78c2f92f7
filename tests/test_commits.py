"""Batches that appear whole or not at all, folds, ids seen before."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.schemas import simple
from plenum.session import scratch_path
from plenum.sources import records
from plenum.streaming import commits, incremental, seen
from tests.conftest import rows

ITEM = simple("k string, n bigint")


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def feed(spark, folder, schema=ITEM):
    return incremental.record_stream(spark, str(folder), schema, 1)


def items(spark, folder):
    return records.scan_jsonl(spark, str(folder), ITEM, strict=False)


class Killed(RuntimeError):
    pass


def kill(monkeypatch, method, when):
    """Let a method of the log fail at some of its calls, after it has done its work or before."""
    whole, calls = getattr(commits.BatchLog, method), []

    def cut(self, *args, **more):
        calls.append(args)
        if when(len(calls), args):
            raise Killed(method)
        return whole(self, *args, **more)

    monkeypatch.setattr(commits.BatchLog, method, cut)


@pytest.mark.parametrize("method, when", [("_write", lambda n, a: n == 4), ("_publish", lambda n, a: n == 2)])
def test_a_kill_between_the_writes_of_a_batch(spark, tmp_path, monkeypatch, method, when):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        put(source, f"{i}.json", f'{{"k": "a{i}", "n": {i}}}', "cut", f'{{"k": "b{i}", "n": {i}}}')
    score = lambda df: df.withColumn("twice", F.col("n") * 2)
    run = lambda: incremental.score_incrementally(feed(spark, source), score, target, target + "-c", target + "-v")
    with monkeypatch.context() as m:
        kill(m, method, when)
        with pytest.raises(Exception, match=method):
            run()
    log = incremental.batch_log(spark, target, target + "-c", None, violations=target + "-v")
    folders = len(list(Path(target).glob("attempt=*"))) + len(list(Path(target + "-v").glob("attempt=*")))
    assert log.state().last == 0 and folders > 2  # files of the second batch are there, its record is not
    assert log.rows("rows", simple("k string, n bigint, twice bigint, batch bigint")).count() == 2
    assert incremental.broken_lines(spark, target, target + "-c", target + "-v").count() == 1
    # a stray folder, and one whose name looks like a batch
    for name in ("attempt=1-stray", "batch=7"):
        spark.createDataFrame([("stray", 1, 2, 0)], "k string, n bigint, twice bigint, batch bigint").write.parquet(f"{target}/{name}")
    got = run().select("k", "n", "twice")
    assert rows(got) == rows(score(items(spark, source)))
    assert incremental.broken_lines(spark, target, target + "-c", target + "-v").count() == 3
    assert rows(run().select("k", "n", "twice")) == rows(got)


def test_another_run_has_a_log_of_its_own(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        put(source, f"{i}.json", f'{{"k": "a{i}", "n": {i}}}')
    run = lambda fp, folder: incremental.score_incrementally(
        feed(spark, folder), lambda df: df, target, incremental.checkpoint_path(spark, target, fp), target + "-v", fp
    )
    assert run("one", source).count() == 3
    put(tmp_path / "less", "0.json", '{"k": "z", "n": 0}')
    assert rows(run("two", tmp_path / "less").select("k")) == [("z",)]  # the former run's batches 1 and 2 do not count
    assert run("one", source).count() == 3


def test_missing_or_changed_files_are_told(spark, tmp_path):
    target = str(tmp_path / "t")
    log = commits.BatchLog(spark, target, "fp", {"rows": target})
    assert log.commit(0, {"rows": spark.range(5)}) and not log.commit(0, {"rows": spark.range(9)})
    assert log.rows("rows", spark.range(0).schema).count() == 5
    file = next(Path(target).glob("attempt=*/part-*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    assert len(log.damaged()) == 1
    with pytest.raises(RuntimeError, match="missing or changed"):
        log.rows("rows", spark.range(0).schema)
    with pytest.raises(RuntimeError, match="another run"):
        other = commits.BatchLog(spark, target, "fp", {"rows": target})
        other.fingerprint = "else"
        other.state()


def test_folds_bound_what_is_read_and_a_killed_one_loses_nothing(spark, tmp_path, monkeypatch):
    source, target, rng = tmp_path / "in", str(tmp_path / "out"), random.Random(3)
    for i in range(8):
        put(source, f"{i:02}.json", *[f'{{"k": "g{rng.randrange(4)}", "n": {rng.randrange(10)}}}' for _ in range(6)])
    run = lambda: incremental.running_counts(feed(spark, source), ["k"], {"big": "n > 4"}, target, target + "-c", fold_every=3)
    with monkeypatch.context() as m:
        kill(m, "_publish", lambda n, a: a[0].startswith("fold-"))
        with pytest.raises(Exception, match="_publish"):
            run()
    log = incremental.batch_log(spark, target, target + "-c", None)
    assert log.state().folded == -1 and log.state().last >= 2
    got = run()
    assert rows(got) == rows(items(spark, source).groupBy("k").agg(F.count("*"), F.count_if(F.expr("n > 4"))))
    state = log.state()
    assert state.folded >= 5 and state.last == 7
    stored = log.rows("rows", simple("k string, samples bigint, big bigint, batch bigint"))
    assert stored.count() <= 4 + 4 * 3
    kept = {f.path.split("/attempt=")[1].split("/")[0] for f in state.files}
    there = {p.name.removeprefix("attempt=") for p in Path(target).glob("attempt=*")}
    assert kept <= there and len(there) < 8  # files that no reader needs are gone
    assert {r["kind"] for r in log.manifest().collect()} == {"batch", "fold"}


KEYS = simple("a string, b bigint")


def index(spark, target, **shape):
    log = commits.BatchLog(spark, target, "fp", {"rows": target, "ids": target + "/_ids", "filters": target + "/_filters"})
    return seen.SeenIds(log, ["a", "b"], KEYS, seen.IndexShape(**shape))


@pytest.mark.parametrize("bits", [64, 4096])  # the small filter says "maybe" to nearly all ids
def test_new_ids_are_exact_over_many_batches(spark, tmp_path, bits):
    known, rng, before = index(spark, str(tmp_path / "t"), buckets=8, bits=bits, hashes=3, fold_every=3), random.Random(5), set()
    schema, total = simple("a string, b bigint, v bigint"), 0
    for batch_id in range(5):
        batch = [(rng.choice(["x", "y", None]), rng.choice([None, *range(40)]), i) for i in range(50)]
        known.keep_new(spark.createDataFrame(batch, schema), batch_id)
        total = len(before | {(a, b) for a, b, _ in batch})
        stored = known.log.rows("rows", simple("a string, b bigint, v bigint, batch bigint"))
        fresh = {(r["a"], r["b"]) for r in stored.filter(F.col("batch") == batch_id).collect()}
        assert fresh == {(a, b) for a, b, _ in batch} - before
        before |= fresh
        known.keep_new(spark.createDataFrame([("z", 1, 1)] + batch, schema), batch_id)  # repeated, even with other rows
        assert stored.count() == total == known._ids().count()
    assert known.log.state().folded >= 2
    files = [f for f in known.log.state().files if f.table == "ids"]
    assert len(files) < 5 * 8


def test_only_own_buckets_are_read(spark, tmp_path):
    known = index(spark, str(tmp_path / "t"), buckets=64, bits=1 << 12)
    rows_of = lambda numbers: spark.createDataFrame([("x", n) for n in numbers], KEYS)
    known.keep_new(rows_of(range(500)), 0)
    fresh, buckets, _ = known.split(rows_of([7, 10_000]))
    assert rows(fresh.select("b")) == [(10_000,)] and 1 <= len(buckets) <= 2
    assert known._ids(buckets).count() < 100
    fresh, buckets, _ = known.split(rows_of(range(20_000, 20_100)))
    assert fresh.count() == 100 and len(buckets) < 10  # the filters alone answer for most


def test_a_kill_between_ids_and_rows(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", scratch_path(spark, "seen")
    for i in range(4):
        put(source, f"{i}.json", *[f'{{"k": "id{(i * 3 + j) % 8}", "n": {i}}}' for j in range(5)])
    shape = seen.IndexShape(buckets=4, bits=256, fold_every=2)
    run = lambda: incremental.first_of_each_id(feed(spark, source), ["k"], target, target + "-c", index=shape)
    with monkeypatch.context() as m:
        kill(m, "_write", lambda n, a: a[0] == "rows" and a[2] == 1)
        with pytest.raises(Exception, match="_write"):
            run()
    got = run()
    assert sorted(r["k"] for r in got.collect()) == [f"id{i}" for i in range(8)]
    assert sorted(r["k"] for r in run().collect()) == [f"id{i}" for i in range(8)]


def test_event_time_keeps_bounded_state(spark, tmp_path):
    source, target = tmp_path / "in", scratch_path(spark, "timed")
    put(source, "0.json", '{"k": "a", "t": "2024-01-01T00:00:00Z"}', '{"k": "a", "t": "2024-01-01T00:01:00Z"}')
    stream = feed(spark, source, T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.TimestampType())]))
    got = incremental.first_of_each_id(stream, ["k"], target, target + "-c", "t", "1 hour")
    assert [r["k"] for r in got.collect()] == ["a"]
