"""Strict scans, atomic sinks, manifests, resumable streams."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from plenum.schemas import simple
from plenum.session import scratch_path, shared_dir
from plenum.sources import benchmarks, files, hashtree, manifest, records, sinks
from plenum.streaming import incremental
from tests.conftest import rows

ROW = simple("a string, b int")


def put(tmp_path, name, *lines):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scan_jsonl(spark, tmp_path):
    good = put(tmp_path, "good.jsonl", '{"a": "x", "b": 1}', "", "  ", '{"b": null}')
    assert rows(records.scan_jsonl(spark, good, ROW)) == [("x", 1), (None, None)]
    assert records.count_jsonl(spark, good, ROW) == 2
    assert records.count_jsonl(spark, put(tmp_path, "empty.jsonl", ""), ROW) == 0


@pytest.mark.parametrize("line", ["[1, 2]", "3", "null", '{"a": ', '{"a": "x", "b": "text"}'])
def test_broken_lines_fail(spark, tmp_path, line):
    path = put(tmp_path, "bad.jsonl", '{"a": "x"}', line)
    with pytest.raises(Exception, match="broken"):
        records.scan_jsonl(spark, path, ROW).collect()
    assert records.scan_jsonl(spark, path, ROW, strict=False).count() == 1
    assert records.jsonl_violations(spark, path, ROW).first().value == line


def test_document_root_must_be_an_object(spark, tmp_path):
    put(tmp_path, "m/x/metrics.json", "{", ' "a": "one", "b": 2', "}")
    got = records.scan_documents(spark, str(tmp_path / "m"), ROW, {"model": "m/([^/]+)/"})
    assert rows(got) == [("x", "one", 2)]
    put(tmp_path, "n/metrics.json", "[]")
    with pytest.raises(Exception, match="no JSON object"):
        records.scan_documents(spark, str(tmp_path / "n"), ROW).collect()


def test_csv_without_missing(spark, tmp_path):
    good = put(tmp_path, "g.csv", "a,b", "x,1", "y,2")
    assert rows(records.scan_csv(spark, good, ROW)) == [("x", 1), ("y", 2)]
    bad = put(tmp_path, "b.csv", "a,b", "x,1", " N/A ,2")
    with pytest.raises(Exception, match="missing value"):
        records.scan_csv(spark, bad, ROW).count()


def test_examples(spark, tmp_path):
    examples = [{"input": f"i{i}", "target": "t"} for i in range(3)]
    put(tmp_path, "bbh/navigate.json", json.dumps({"examples": examples}))
    wanted = spark.createDataFrame([("navigate",)], "subject string")
    out = benchmarks.scan_examples(spark, str(tmp_path / "bbh"), wanted)
    assert [r.input for r in out.orderBy("source_index").collect()] == ["i0", "i1", "i2"]
    more = spark.createDataFrame([("navigate",), ("snarks",)], "subject string")
    with pytest.raises(RuntimeError, match="missing category"):
        benchmarks.scan_examples(spark, str(tmp_path / "bbh"), more)
    with pytest.raises(ValueError, match="unknown data set"):
        benchmarks.resolve("nope")
    with pytest.raises(FileNotFoundError):
        benchmarks.scan_splits(spark, {"train": [str(tmp_path / "none.parquet")]})


def test_failed_write_keeps_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.write_jsonl(spark.createDataFrame([("x", None)], ROW), path) == 1
    broken = spark.createDataFrame([("y", 2)], ROW).withColumn("a", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_jsonl(broken, path)
    assert rows(records.scan_jsonl(spark, path, ROW)) == [("x", None)]
    assert sinks.write_jsonl(spark.createDataFrame([("z", 3)], ROW), path) == 1
    assert rows(records.scan_jsonl(spark, path, ROW)) == [("z", 3)]


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    source, target = tmp_path / "in", scratch_path(spark, "t")
    schema = simple("k string, ok boolean")
    put(source, "1.json", '{"k": "a", "ok": true}', '{"k": "b", "ok": false}')

    def run(fn, *args):
        stream = incremental.record_stream(spark, str(source), schema, 1)
        return fn(stream, *args)

    score = lambda df: df.withColumn("n", F.length("k"))
    assert run(incremental.score_incrementally, score, target, target + "-c", target + "-v").count() == 2
    put(source, "2.json", '{"k": "a", "ok": true}', '{"k": "cut', "[]", "  ")
    assert run(incremental.score_incrementally, score, target, target + "-c", target + "-v").count() == 3
    assert [r[0] for r in spark.read.parquet(target + "-v").select("_broken").orderBy("_broken").collect()] == ["[]", '{"k": "cut']

    counts = run(incremental.running_counts, ["k"], {"good": "ok"}, target + "-n", target + "-nc")
    batch = records.scan_jsonl(spark, str(source), schema, strict=False).groupBy("k").agg(F.count("*"), F.count_if("ok"))
    assert rows(counts) == rows(batch)

    kept = run(incremental.first_of_each_id, ["k"], target + "-d", target + "-dc")
    received = records.scan_jsonl(spark, str(source), schema, strict=False)
    assert rows(incremental.dropped_rows(received, kept.select("k"))) == [(3, 2, 1)]
    assert "fp1" in incremental.checkpoint_path(spark, "score", "fp1")
    assert shared_dir(spark) == shared_dir(spark)


def test_manifest_files(spark, tmp_path):
    for folder, line in (("a/x", '{"a": "1", "b": 1}'), ("b/x", '{"a": "2", "b": 2}')):
        put(tmp_path / folder, "f+ 1.json", line)
    put(tmp_path, "top.json", "{")
    root = str(tmp_path)
    both = spark.createDataFrame([("a/x/f+ 1.json", "one"), ("b/x/f+ 1.json", "two")], "path string, cell string")
    out = records.scan_manifest_files(spark, root, ROW, both).select("path", "cell", "a")
    assert rows(out) == [("a/x/f+ 1.json", "one", "1"), ("b/x/f+ 1.json", "two", "2")]
    one = both.filter("cell = 'one'")
    assert records.scan_manifest_files(spark, root, ROW, one).count() == 1
    absent = one.unionByName(spark.createDataFrame([("c/x/f+ 1.json", "three")], "path string, cell string"))
    assert rows(records.unlisted_files(spark, root, absent)) == [("c/x/f+ 1.json", "three")]
    with pytest.raises(Exception, match="missing"):
        records.scan_manifest_files(spark, root, ROW, absent)
    hashes = records.file_hashes(spark, root, ["a/x/f+ 1.json"])
    assert records.scan_manifest_files(spark, root, ROW, one.join(hashes, "path")).count() == 1
    with pytest.raises(Exception, match="hash"):
        records.scan_manifest_files(spark, root, ROW, one.withColumn("sha256", F.lit("0")))
    top = spark.createDataFrame([("top.json", "t")], "path string, cell string")
    with pytest.raises(Exception, match="broken line"):
        records.scan_manifest_files(spark, root, ROW, top).collect()
    assert records.scan_manifest_files(spark, root, ROW, top, strict=False).count() == 0


def test_line_numbers_of_split_files(spark, tmp_path):
    rng, wanted = random.Random(2), []
    folder = tmp_path / "many"
    for f in range(3):
        lines = [rng.choice(['{"a": "x", "b": 1}', "", "   ", "[1]", '{"a": "long ' + "y" * rng.randint(0, 300) + '"}']) for _ in range(700 * f + 3)]
        put(folder, f"{f}.jsonl", *lines)
        wanted += [(f"{f}.jsonl", n, line) for n, line in enumerate(lines, 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = records.numbered_lines(spark, str(folder))
        got = [(r["file"].rsplit("/", 1)[-1], r["line_no"], r["value"]) for r in lines.collect()]
        assert sorted(got) == sorted(wanted)
        assert lines.rdd.getNumPartitions() > 10  # byte ranges, several to a file
        broken = records.jsonl_violations(spark, str(folder), ROW).collect()
        assert sorted((r["file"].rsplit("/", 1)[-1], r["line_no"]) for r in broken) == sorted(w[:2] for w in wanted if w[2] == "[1]")
        first = min(w[:2] for w in wanted if w[2] == "[1]")
        with pytest.raises(RuntimeError, match=f"broken record in .*{first[0]}:{first[1]}$"):
            records.count_jsonl(spark, str(folder), ROW)
        with pytest.raises(Exception, match=r"broken line in [^ ]*jsonl:[0-9]+: \[1\]"):
            records.scan_jsonl(spark, str(folder), ROW).count()
        with pytest.raises(Exception, match=r"broken line in [^ ]*jsonl: \[1\]"):
            records.scan_jsonl(spark, str(folder), ROW, numbered=False).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_digests_are_read_in_blocks(spark, tmp_path, monkeypatch):
    big = tmp_path / "d" / "big file+1.bin"
    big.parent.mkdir()
    with big.open("wb") as out:
        out.seek((2 << 30) + 5)  # above what one cell may hold
        out.write(b"end")
    (tmp_path / "d" / "empty").write_bytes(b"")
    running = hashlib.sha256()
    with big.open("rb") as back:
        while block := back.read(1 << 20):
            running.update(block)
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in manifest.inventory(spark, str(tmp_path / "d")).collect()}
    assert found == {"big file+1.bin": ((2 << 30) + 8, running.hexdigest()), "empty": (0, hashlib.sha256().hexdigest())}
    peak = max(len(b) for b in files._blocks(str(tmp_path / "d"), "big file+1.bin"))
    assert peak <= files.BLOCK_BYTES
    with pytest.raises(Exception, match="none"):
        files.digests(spark.createDataFrame([("none",)], "path string"), str(tmp_path / "d")).collect()


def test_lines_of_streams(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bc", "\n", "\r", "\r\n", "é"], k=rng.randint(0, 30))).encode()
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 5)))
        blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)]) if a < b]
        wanted = text.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n")
        wanted = wanted[:-1] if not wanted[-1] else wanted
        assert [line.decode() for line in files._split(iter(blocks))] == wanted
        packed = gzip.compress(text[:7]) + gzip.compress(text[7:])
        parts = [packed[i : i + 5] for i in range(0, len(packed), 5)]
        assert b"".join(files._unpacked(iter(parts), True)) == text
        if text:
            with pytest.raises(EOFError):
                list(files._unpacked(iter([packed[:-3]]), True))


def test_hash_tree_names_the_changed_range(spark):
    old = spark.range(5000).select("id", (F.col("id") * 7).alias("v"))
    tree = lambda df: hashtree.hash_tree(df, "id", width=10, fanout=4)
    before = tree(old)
    assert before.filter("level = 0").count() == 500 and before.groupBy("level").count().orderBy(F.desc("level")).first()["count"] == 1
    changes = lambda df: rows(hashtree.changed_ranges(before, tree(df), 10, 4))
    assert changes(old.orderBy(F.desc("v"))) == []
    one = old.withColumn("v", F.when(F.col("id") == 1234, -1).otherwise(F.col("v")))
    assert changes(one) == [(123, 1230, 1239, 10, 10, "changed")]
    assert changes(old.filter("id < 4995")) == [(499, 4990, 4999, 10, 5, "changed")]
    assert changes(old.filter("id < 4990")) == [(499, 4990, 4999, 10, None, "removed")]
    more = old.unionByName(spark.createDataFrame([(90_000, 1), (-5, 2), (None, 3)], "id bigint, v bigint"))
    found = hashtree.changed_ranges(before, tree(more), 10, 4).select("range", "change").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(9000, "added"), (-1, "added"), (None, "added")], key=repr)
    empty = old.filter("false")
    assert tree(empty).count() == 0 and len(changes(empty)) == 500
    assert hashtree.changed_ranges(tree(empty), tree(empty), 10, 4).count() == 0


def test_staleness_goes_to_later_stages_only(spark):
    status = spark.createDataFrame([("a", "complete"), ("b", "stale"), ("c", "complete"), ("d", "complete"), ("e", "missing"), ("f", "complete")], "stage string, status string")
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c"), ("f", "a"), ("a", "f"), ("d", "e")], "stage string, upstream string")
    assert rows(hashtree.carry_staleness(status, edges)) == [
        ("a", "complete", None), ("b", "stale", None), ("c", "stale", "b"), ("d", "stale", "b"), ("e", "missing", None), ("f", "complete", None)
    ]


def test_files_are_dealt_out_to_tasks(spark, tmp_path):
    """Adaptive execution does not put all files into one task because their paths are short."""
    for i in range(40):
        put(tmp_path, f"{i}.json", "{}", "", "{")
    listed = spark.createDataFrame([(f"{i}.json", i % 3) for i in range(40)] + [("0.json", 9), (None, 1)], "path string, cell int")
    seen = files.stream_lines(listed.select("path").distinct(), str(tmp_path)).withColumn("task", F.spark_partition_id())
    found = seen.groupBy("task").agg(F.countDistinct("path").alias("n")).collect()
    assert len(found) > 8 and sum(r["n"] for r in found) == 40
    listed = listed.filter("path is not null")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", files.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    try:
        grouped = files.stream_lines(listed.groupBy("path").agg(F.max("cell")), str(tmp_path))
        assert grouped.select(F.spark_partition_id()).distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = records.scan_manifest_files(spark, str(tmp_path), ROW, listed, strict=False).select("path", "cell")
    assert rows(out) == sorted([(f"{i}.json", i % 3) for i in range(40)] + [("0.json", 9)], key=repr)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    alone = records.scan_manifest_files(spark, str(tmp_path), ROW, listed.select("path"), spread=3, strict=False)
    assert alone.columns == ["path", *ROW.names] and alone.count() == 41 and alone.rdd.getNumPartitions() == 3


def test_lines_of_a_stream_keep_their_numbers(spark, tmp_path, monkeypatch):
    """Long files, long lines, lines that are no UTF-8, and ends of all kinds; rows of the table of paths go along."""
    lines = [b"x" * (i % 700) + bytes([255]) * (i % 50 == 0) + "é".encode() for i in range(9001)]
    (tmp_path / "a.txt").write_bytes(b"\r\n".join(lines) + b"\r\n\r\nlast")
    (tmp_path / "b.txt").write_bytes(b"")
    paths = spark.createDataFrame([("a.txt", ["one", None]), ("b.txt", None)], "path string, cell array<string>")
    got = files.stream_lines(paths, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == list(range(1, 9004)) and {tuple(r["cell"]) for r in got} == {("one", None)}
    assert [r["value"] for r in got] == [x.decode("utf-8", "replace") for x in [*lines, b"", b"last"]]
    groups = [*files._held(iter([[b"a"] * 10_000, [b"b" * (5 << 20)], [b"c" * (5 << 20)], [b""]]))]
    assert [x for g in groups for x in g] == [b"a"] * 10_000 + [b"b" * (5 << 20), b"c" * (5 << 20), b""]
    assert max(map(len, groups)) <= files.LINES_AT_ONCE and all(sum(map(len, g)) <= files.LINES_BYTES for g in groups)
