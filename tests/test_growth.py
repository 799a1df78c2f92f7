"""What keeps tasks and the driver small while tables grow; each table here is a few rows."""

import datetime
import gzip
import json

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from plenum.catalog import QUERIES, inputs, prompting
from plenum.functions import cleaning, matching
from plenum.operators import baselines, joins, preference, quality, ranking, records as answers
from plenum.schemas import simple
from plenum.sources import records


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders with keys below and above 2**23, one key twice and one null."""
    at = str(tmp_path_factory.mktemp("orders"))
    keys = [0, 1, 7, 7, 23, 150_000, 2**23 - 1, 2**23, 2**23 + 5, 2**24 + 11, None]
    made = [(k, i * 5 + 1, "O", 1.5, datetime.datetime(2020, 1, 1), f"{i % 5}-X") for i, k in enumerate(keys)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


def test_rewards_are_not_broadcast(spark):
    grid = spark.createDataFrame([("a", "x"), ("b", "x")], "sample_id string, candidate string")
    rolled = grid.withColumn("correct", F.explode(F.array(F.lit(True), F.lit(False))))
    out = preference.rollout_rewards(rolled, ["sample_id", "candidate"], 2, grid)
    assert "Broadcast" not in plan(out)
    assert rows(out) == [("a", "x", 1, 2, 0.5), ("b", "x", 1, 2, 0.5)]


@pytest.mark.parametrize("name", ["mc_rollout_reward", "job_debate_rounds", "render_peer_prompts"])
def test_expanded_grids_are_not_broadcast(spark, orders, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, orders))


def test_lines_of_listed_files_are_streamed_past_the_manifest(spark, tmp_path):
    for name, size in (("a", 3), ("b", 2)):
        with gzip.open(tmp_path / f"{name}.txt.gz", "wt") as f:
            f.writelines(json.dumps({"n": i}) + "\n" for i in range(size))
    listed = spark.createDataFrame([("a.txt.gz", "A"), ("b.txt.gz", "B")], "path string, cell string")
    out = records.scan_manifest_files(spark, str(tmp_path), simple("n int"), listed).select("cell", "n")
    assert "Broadcast" not in plan(out) and "SortMergeJoin" not in plan(out)
    assert rows(out) == [("A", 0), ("A", 1), ("A", 2), ("B", 0), ("B", 1)]


def test_large_order_keys_have_seeds(spark, orders):
    found = QUERIES["derive_seeds"](spark, orders).select("sample_index", "request_seed")
    keys = [r.sample_index for r in inputs.samples(spark, orders).select("sample_index").collect()]
    wanted = [(k, None if k is None else (42 << 31) | (k << 8) | (k % 5)) for k in keys]
    assert rows(found) == sorted(wanted, key=repr)


def test_each_prompt_once_without_a_sort(spark):
    asked = spark.createDataFrame([("p",), ("q",), ("p",), (None,), ("",)], "prompt string")
    found = joins.distinct_requests(asked)
    assert "Sort" not in plan(found)
    assert rows(found.select("prompt", "users")) == [("", 1), ("p", 2), ("q", 1)]
    assert rows(found.select(F.col("prompt_hash") == F.sha2("prompt", 256))) == [(True,)] * 3


def test_a_task_expands_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 20)
    made = spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1-X").alias("o_orderpriority")
    )
    made.write.parquet(f"{tmp_path}/orders.parquet")
    sizes = [r[1] for r in inputs.samples(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 90 and max(sizes) < 60


def test_a_task_has_as_many_rows_with_trials_as_without(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    made = spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1-X").alias("o_orderpriority")
    )
    made.write.parquet(f"{tmp_path}/orders.parquet")
    voted = inputs.votes(spark, str(tmp_path), trials=5)
    sizes = [r[1] for r in voted.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 * 75 and max(sizes) < 60 * 75


@pytest.mark.parametrize("name", ["last_round", "join_roles_nway"])
def test_votes_by_sample_id_are_not_shuffled_again(spark, orders, name):
    text = plan(QUERIES[name](spark, orders))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text


def test_votes_of_agents_need_no_join_by_sample(spark, orders):
    """Only the few rows of a data set and round are joined; rows with a null in a key have no vote."""
    text = plan(QUERIES["som_metrics"](spark, orders))
    assert text.count("Join") == 1 and "sample_index" not in "".join(x for x in text.splitlines() if "Join" in x)
    made = [("d", 1, s, a, "multiple_choice", g, x) for s, g, answers in (
        (1, "A", "AAB"), (2, "B", "AB "), (3, "C", "   "), (None, "A", "AAA")) for a, x in enumerate(answers)]
    made += [(None, 1, 4, 0, "multiple_choice", "A", "A")]
    votes = spark.createDataFrame(made, "dataset string, round int, sample_index bigint, agent int, task_type string, gold string, answer string")
    scored = votes.withColumns({"correct": F.col("answer") == F.col("gold"), "parsed": F.col("answer") != " ", "truncated": F.lit(False)})
    found = baselines.som_scores(scored, ["dataset"], 4).select("dataset", "agent_decisions", "samples", "plurality_vote_accuracy", "plurality_vote_coverage")
    assert rows(found) == [("d", 12, 3, 1 / 3, 1 / 3)]


def test_records_are_nested_without_a_second_shuffle(spark, orders):
    nested = inputs.records(spark, orders, trials=5)
    assert plan(nested).count("Exchange") == 1
    key = ["dataset", "sample_index", "sample_id", "role", "role_idx", "trial"]
    assert nested.count() == nested.select(*key).distinct().count() == 10 * 3 * 5


ODD = ["", None, "A", " A", "A ", "One.  Two", "One. Two", "so , yes", "a  b", "a\tb", "The answer is", "the anſwer iſ", "Answer:",
       "Keep this. answer ;", "use /NO_think", "x <b> y", "a\nb", "a\r\nb", "a b", "\x1fA", "A　", "a￿b"]


def test_texts_that_skip_the_cleaning_are_clean(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, "The final result is A.", "I choose B", "Answer: C, of course!"]], "t string")
    plain = df.filter(~F.col("t").rlike(cleaning.UNSETTLED))
    assert {r.t for r in plain.collect()} == {"", "A", "The final result is A.", "I choose B", "Answer: C, of course!"}
    by_rules = cleaning.squeeze(cleaning.drop_empty_claims(F.array_join(cleaning.paragraphs_of(cleaning.visible_text(F.col("t"))), "\n\n")))
    assert plain.filter(by_rules != F.col("t")).count() == 0
    done = cleaning.with_clean_response(plain, "t", "c")
    assert done.filter("c <> t").count() == 0


def test_single_labels_skip_the_rules(spark):
    """No rule that runs row by row outside compiled code is reached by plain letters and words."""
    values = [(a, t) for a in ("A", "Z", "YES", "NO", "Y", "yes", "(b)", "", None, "AB", "É") for t in ("yes_no", "multiple_choice", "mixed", "math", None)]
    df = spark.createDataFrame(values, "a string, t string")
    padded = F.concat(F.lit(" "), "a", F.lit(" "))  # not a plain label: goes through the rules
    for rule in (matching.vote_label, matching.audit_label, matching.match_label):
        task = F.when(F.col("t") == "math", F.lit(None)).otherwise(F.col("t")) if rule is matching.vote_label else F.col("t")
        same = rule(F.col("a"), task).eqNullSafe(rule(padded, task))
        assert df.filter(~same).count() == 0


def test_checks_of_records_are_not_shuffled(spark, orders):
    """Records are dealt out once by the sample, and what is checked by sample stays there."""
    text = plan(QUERIES["job_evaluate"](spark, orders))
    assert "sample_id" not in "".join(x for x in text.splitlines() if "Exchange" in x and "REPARTITION" not in x)


def test_records_hold_the_greatest_turn_of_repeated_orders(spark, orders):
    found = {(r.sample_index, r.role): r for r in inputs.records(spark, orders).collect()}
    rows_ = inputs.completions(spark, orders).filter("sample_index = 7").collect()
    for role in inputs.ROLES:
        rounds = found[7, role].rounds
        assert [t.round for t in rounds] == list(range(5))
        for t in rounds:
            texts = [r.tail_text for r in rows_ if r.role == role and r["round"] == t.round]
            assert len(texts) == 2 and t.actor.completion.raw_response == max(texts) == t.actor.completion.response
    assert len(found) == 30


def test_pairs_are_read_once_for_all_problems(spark):
    made = [(1, 1, "critic", 1, "p", "a", "b"), (1, 1, "actor", 1, " ", "a", "a "), (2, 9, "critic", 1, "p", "a", "b"), (None, 1, "critic", 1, "p", "a", "b"), (None, 1, "critic", 1, "p", "a", "b")]
    pairs = spark.createDataFrame(made, "sample_index int, round int, agent string, iteration int, prompt string, chosen string, rejected string")
    out = quality.pair_problems(pairs, "critic", 1, spark.createDataFrame([(1,), (1,), (None,)], "sample_index int"))
    assert plan(out).count("Scan ExistingRDD") == 2 and "Broadcast" not in plan(out)
    assert rows(out) == sorted([
        (1, 1, "provenance"), (1, 1, "blank"), (1, 1, "identical"), (1, 1, "repeated"), (2, 9, "round"), (2, 9, "unexpected sample"),
        (None, 1, "repeated"), (None, 1, "unexpected sample"), (None, 1, "unexpected sample"),
    ], key=repr)


def test_coverage_of_null_keys(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    other = spark.createDataFrame([("b",), ("c",), (None,), (None,)], "k string")
    assert rows(quality.coverage(keys, other, ["k"])) == [("a", "extra"), ("c", "missing"), (None, "extra"), (None, "missing")]


def test_numbers_come_first_in_sorted_groups(spark):
    df = spark.createDataFrame([("x", 1, "y")], "dataset string, sample_index bigint, role string")
    assert ranking.numbers_first(df, ["dataset", "sample_index", "role"]) == ["sample_index", "dataset", "role"]
    df = df.withColumn("trial", F.lit(1))
    assert ranking.numbers_first(df, ["dataset", "trial", "sample_index", "role"]) == ["sample_index", "trial", "dataset", "role"]


@pytest.mark.parametrize("name", ["selection_summary", "check_pairs"])
def test_texts_of_candidates_are_not_broadcast(spark, orders, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, orders))


def test_orders_are_grouped_before_they_become_records(spark, orders):
    """No record is grouped or sorted by itself, and checks of the scores' groups do not split the key of every row."""
    text = plan(inputs.records(spark, orders, trials=5))
    assert "role" not in "".join(x for x in text.splitlines() if "Aggregate" in x or "Sort" in x)
    whole = plan(QUERIES["job_evaluate"](spark, orders))
    assert "size(array(" not in whole and "size(rounds" not in whole and "isnotnull(split(" not in whole


def test_first_rounds_of_records(spark, orders):
    every, four = (inputs.records(spark, orders, trials=2, rounds=n) for n in (5, 4))
    cut = every.withColumn("rounds", F.slice("rounds", 1, 4))
    assert rows(four) == rows(cut) and four.count() == 10 * 3 * 2


def test_only_the_fields_asked_for_are_read_of_nested_rounds(spark, tmp_path):
    completion = "struct<raw_response:string,answer:string,parsed:boolean,correct:boolean,truncated:boolean>"
    schema = f"id int, rounds array<struct<round:int,actor:struct<completion:{completion}>>>"
    one = [(0, (("text", "A", True, None, False),)), None, (2, (("text", None, None, True, True),)), (3, None)]
    made = [(1, one), (2, []), (3, None)]
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/records")
    flat = answers.flatten_rounds(spark.read.parquet(f"{tmp_path}/records"), ["id"])
    assert rows(flat) == sorted([
        (1, 0, "A", True, False, False), (1, None, None, False, False, False), (1, 2, None, False, True, True), (1, 3, None, False, False, False),
    ], key=repr)
    assert "raw_response" not in plan(flat) and "truncated" not in plan(flat.select("id", "round", "correct")).split("ReadSchema")[1]


def test_trials_of_unlike_samples_are_found(spark):
    made = [("a", t, s) for t in (0, 1) for s in ("x", "y", "y", None)] + [("b", 0, "x"), ("b", 1, "y")] + [("c", 0, "x"), ("c", 2, "x")]
    found = quality.trials_not_contiguous(spark.createDataFrame(made, "g string, trial int, s string"), ["g"], "s")
    assert rows(found.select("g", "trials", "same_samples")) == [("b", 2, False), ("c", 2, True)]


def test_rounds_that_are_not_contiguous(spark):
    made = [("ok", [(0,), (1,)]), ("gap", [(0,), (2,)]), ("null", [(0,), None]), ("short", [(0,)]), ("none", None), ("empty", [])]
    df = spark.createDataFrame(made, "k string, rounds array<struct<round:bigint>>")
    assert rows(quality.rounds_not_contiguous(df, "k", count=2).select("k")) == [("empty",), ("gap",), ("none",), ("null",), ("short",)]
    assert rows(quality.rounds_not_contiguous(df, "k").select("k")) == [("empty",), ("gap",), ("none",), ("null",)]


def test_rounds_of_a_debate_are_not_shuffled(spark, orders):
    """Orders are dealt out by the sample, and answers meet those of the round before where they are."""
    out = QUERIES["job_debate_rounds"](spark, orders)
    assert "ENSURE_REQUIREMENTS" not in plan(out)
    sizes = {(r.sample_index, r["round"]): r["count"] for r in out.groupBy("sample_index", "round").count().collect()}
    assert sizes.pop((7, 0)) == 3 * 4 and {sizes.pop((7, i)) for i in range(1, 5)} == {3 * 8}  # the key that comes twice
    assert len(sizes) == 8 * 5 and set(sizes.values()) == {3}


def test_debate_prompts_hold_the_answer_of_the_same_role_one_round_before(spark, orders):
    told = {(r.sample_index, r.role, r["round"]): r.tail_text for r in inputs.completions(spark, orders).filter("sample_index <> 7").collect()}
    made = prompting.debate_rounds(spark, orders).filter("sample_index <> 7").collect()
    for r in made:
        before = told.get((r.sample_index, r.role, r["round"] - 1))
        assert ("Person 0 said" not in r.prompt) if before is None else (f"Person 0 said: {before}\nPerson 1 said: Feedback of {r.role}" in r.prompt)
    assert len(made) == 8 * 15
