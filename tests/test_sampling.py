"""Samples and splits against brute force, including one hot group."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from plenum.functions import seeds
from plenum.operators import joins, quality, ranking, sampling
from tests.conftest import rows


def digest(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    # one group holds most rows
    data = [(f"k{i:05d}", "hot" if i % 3 else f"g{i % 40}") for i in range(3000)]
    return spark.createDataFrame(data, "key string, subject string").repartition(7).cache()


def test_random_sample_is_exact(table):
    keys = [r.key for r in table.collect()]
    want = sorted(keys, key=lambda k: (digest(5, k), k))[:777]
    assert sorted(r.key for r in sampling.sample_random(table, "key", 777, 5).collect()) == sorted(want)
    assert sampling.sample_random(table, "key", 10**6, 5).count() == 3000
    assert sampling.sample_random(table, "key", None, 5).count() == 3000
    with pytest.raises(ValueError):
        sampling.sample_random(table, "key", 0, 5)


@pytest.mark.parametrize("n", [7, 100, 2500])
def test_stratified_sample_is_exact(table, n):
    data = [(r.key, r.subject) for r in table.collect()]
    groups = {}
    for k, g in data:
        groups.setdefault(g, []).append(k)
    quota = max(1, n // len(groups))
    first = {k for g in groups.values() for k in sorted(g, key=lambda k: (digest(9, k), k))[:quota]}
    want = sorted((k for k, _ in data), key=lambda k: (k not in first, digest(9, k), k))[:n]
    got = [r.key for r in sampling.sample_stratified(table, "key", n, 9).collect()]
    assert sorted(got) == sorted(want)


def test_one_group_falls_back_to_random(table):
    one = table.withColumn("subject", F.lit(None).cast("string"))
    a = rows(sampling.sample_stratified(one, "key", 50, 1).select("key"))
    assert a == rows(sampling.sample_random(one, "key", 50, 1).select("key"))


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "name string, size int")
    assert [r.allocated for r in sampling.allocate(sizes, 4).orderBy("name").collect()] == [2, 1, 1]
    assert [r.allocated for r in sampling.allocate(sizes, 0).collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="cannot allocate"):
        sampling.allocate(sizes, 11).collect()
    with pytest.raises(ValueError):
        sampling.allocate(sizes, -1)


def test_split_covers_every_row_once(table):
    out = sampling.split_stratified(table, "key", 3).cache()
    assert out.count() == 3000 and out.select("key").distinct().count() == 3000
    for split, in out.select("source_split").distinct().collect():
        index = sorted(r.source_index for r in out.filter(F.col("source_split") == split).collect())
        assert index == list(range(len(index)))
    hot = out.filter("subject = 'hot'").groupBy("source_split").count().collect()
    assert {r.source_split: r["count"] for r in hot} == {"test": 500, "validation": 200, "train": 1300}


def test_positions_do_not_depend_on_partitions(spark):
    base = spark.range(1000).select((F.col("id") * 977 % 250_003).alias("key"), (F.col("id") % 2).alias("g"))
    a = sampling.source_position(base.repartition(2), ["g"], "key")
    assert rows(a) == rows(sampling.source_position(base.repartition(9), ["g"], "key"))
    for g in (0, 1):
        ordered = a.filter(F.col("g") == g).orderBy("key").collect()
        assert [r.source_index for r in ordered] == list(range(500))


def test_trials_and_shards(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "sample_id string, sample_index int")
    out = sampling.expand_trials(df, 2).orderBy("sample_index").collect()
    assert [r.sample_id for r in out] == ["a__trajectory_00", "a__trajectory_01", "b__trajectory_00", "b__trajectory_01"]
    assert [r.sample_index for r in out] == [0, 1, 2, 3]
    assert sampling.expand_trials(df, 1).columns == df.columns
    with pytest.raises(ValueError):
        sampling.shard(df, "sample_index", 2, 2)


def test_attach_gold_keeps_unknown_samples_wrong(spark):
    samples = spark.createDataFrame([("a", "A", "multiple_choice"), ("n", None, "math")], "sample_id string, gold string, task_type string")
    found = spark.createDataFrame([("a", "A"), ("a", "B"), ("x", None), ("n", None)], "sample_id string, answer string")
    out = joins.attach_gold(found, samples).select("sample_id", "answer", "correct", "known")
    assert rows(out) == sorted([("a", "A", True, True), ("a", "B", False, True), ("n", None, True, True), ("x", None, False, False)], key=repr)
    assert rows(joins.unmatched_completions(found, samples)) == [("x", 1)]


def test_request_seed_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(0, 0), (seeds.MAX_REQUESTS - 1, 255)], "i long, s long")
    out = [r[0] for r in df.select(seeds.request_seed(1, F.col("i"), F.col("s"))).collect()]
    assert out == [1 << 31, (1 << 31) | ((seeds.MAX_REQUESTS - 1) << 8) | 255]
    for bad in ((seeds.MAX_REQUESTS, 0), (0, 256), (-1, 0)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([bad], "i long, s long").select(seeds.request_seed(1, F.col("i"), F.col("s"))).collect()


def test_order_check(spark):
    data = [(0, 1), (1, 5), (2, 3), (3, 6)]
    df = spark.createDataFrame(data, "pos int, key int")
    assert rows(joins.unsorted_rows(df, "key", "pos", width=2)) == [(2, 3)]


def test_checks_raise_in_strict_mode(spark):
    df = spark.createDataFrame([("a",), ("a",), (" ",)], "sample_id string")
    bad = quality.duplicate_ids(df, "sample_id")
    assert bad.count() == 2
    with pytest.raises(quality.ContractError):
        quality.enforce(bad, "sample ids")
    report = quality.coverage_report(
        quality.coverage(df.filter("sample_id != 'a'"), df, ["sample_id"])
    )
    assert rows(report) == [("missing", "a", 1)]


def test_rows_with_missing_groups_stay(spark):
    df = spark.createDataFrame([(f"k{i}", None if i % 2 else "a") for i in range(40)], "key string, subject string")
    out = sampling.split_stratified(df, "key", 1)
    assert out.count() == 40
    assert sampling.source_position(df.withColumn("n", F.length("key")), ["subject"], "n").count() == 40


def plain_allocation(sizes, total):
    rows = sum(n for _, n in sizes)
    quota = {name: float(n * total) / float(rows) for name, n in sizes}
    floor = {name: math.floor(q) for name, q in quota.items()}
    order = sorted(quota, key=lambda name: (-(quota[name] - floor[name]), name))
    up = set(order[: total - sum(floor.values())])
    return {name: floor[name] + (name in up) for name, _ in sizes}


def test_allocation_of_many_groups(spark):
    rng = random.Random(9)
    for sizes, total in (
        ([(f"n{i:05}", rng.randint(0, 50)) for i in range(3000)], 7001),
        ([(f"n{i:05}", 5) for i in range(3000)], 1234),  # one remainder for all: the names decide
        ([("a", 1), ("b", 1)], 2),
    ):
        df = spark.createDataFrame(sizes, "name string, size bigint").repartition(8)
        got = sampling.allocate(df, total)
        assert dict(got.select("name", "allocated").collect()) == plain_allocation(sizes, total)
        assert "SinglePartition" not in got.filter("name > 'n'").select("allocated")._jdf.queryExecution().optimizedPlan().toString()


def test_range_ranks_have_no_common_task(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"))
    ranked = ranking.with_range_rank(df.repartition(6), [F.col("k").desc()], "r").collect()
    assert [r["k"] for r in sorted(ranked, key=lambda r: r["r"])] == sorted((r["k"] for r in ranked), reverse=True)
    assert [r["r"] for r in sorted(ranked, key=lambda r: r["r"])] == list(range(1, 20_001))
