"""Matching, votes, rewards, pairs, fine-tuning rows."""

import pytest
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match, audit_label, vote_label
from plenum.operators import baselines, fusion, lengths, metrics, preference, records, report, sft
from plenum.plans import jobs
from tests.conftest import rows


def test_labels_disagree_where_they_should(spark):
    data = [("yes_no", "YEAH"), ("multiple_choice", "__UNSCORABLE__"), ("mixed", "yes"), ("math", " 3 ")]
    df = spark.createDataFrame(data, "t string, a string")
    task, answer = F.col("t"), F.col("a")
    out = df.select("a", vote_label(answer, task), answers_match(answer, F.lit("yes"), task)).collect()
    assert [r[1] for r in out] == [None, None, "YES", "3"]
    assert [r[2] for r in out] == [True, False, True, False]
    assert df.limit(1).select(audit_label(F.lit(" (y). "), F.lit("yes_no"))).first()[0] == "YES"


@pytest.mark.parametrize(
    "left, right, equal",
    [
        ("1_000", "1000", True), ("\\frac{1}{2}", "0.5", True), ("\\dfrac{4}{2}", "2", True),
        ("\\frac{1}{0}", "1", False), ("1e-8", "0", True), ("\\text{ab  c}", "ab c", True), (None, "", True),
        ("", None, True), ("x", None, False), ("42", "42.0", True), ("1.0f", "1", False), ("inf", "inf", True),
    ],
)
def test_math_equal(spark, left, right, equal):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    assert df.select(answers_match(F.col("a"), F.col("b"), F.lit("math"))).first()[0] is equal


def vote(spark, answers, roles=fusion.ROLES, task="multiple_choice", gold="A"):
    data = [(1, r, a, True, False, False, task, gold) for r, a in zip(roles, answers)]
    df = spark.createDataFrame(
        data, "k int, role string, answer string, parsed boolean, correct boolean, truncated boolean, task_type string, gold string"
    )
    return fusion.majority_vote(fusion.align_roles(df, ["k"], roles=roles), roles=roles).first()


@pytest.mark.parametrize(
    "answers, answer, source, count",
    [
        (["A", "B", "B"], "B", "majority", 2), (["A", "A", "A"], "A", "unanimous", 3),
        (["A", "B", "C"], "A", "fixed_direct_fallback", 1), ([None, "B", "C"], None, "fixed_direct_fallback", 0),
        ([None, "B", "b"], "B", "majority", 2), ([None, None, None], None, "fixed_direct_fallback", 0),
    ],
)
def test_majority_vote(spark, answers, answer, source, count):
    decision = vote(spark, answers).decision
    assert (decision.answer, decision.source, decision.vote_count) == (answer, source, count)
    assert decision.selected_role == ("direct" if source.startswith("fixed") else None)


ROLE_ROWS = "k int, role string, answer string, parsed boolean, correct boolean, truncated boolean, task_type string, gold string"


@pytest.mark.parametrize("problem", ["missing", "repeated", "different"])
def test_roles_must_be_aligned(spark, problem):
    data = [(k, r, "A", True, True, False, "multiple_choice", "A") for k in (1, 2) for r in fusion.ROLES]
    if problem == "missing":
        data.pop()
    elif problem == "repeated":
        data.append((2, "direct", "B", True, False, False, "multiple_choice", "A"))
    else:
        data[-1] = (2, "verification", "A", True, True, False, "multiple_choice", "B")
    df = spark.createDataFrame(data, ROLE_ROWS)
    assert rows(fusion.alignment_problems(df, ["k"])) == [(2, problem)]
    with pytest.raises(Exception, match="not aligned"):
        fusion.align_roles(df, ["k"]).collect()


def test_fuse_keeps_trials_apart(spark):
    kind = "dataset string, trial int, sample_index int, round int, role string, answer string, parsed boolean, correct boolean, truncated boolean, task_type string, gold string"
    data = [("d", t, 1, r, role, "AB"[t], True, t == 0, False, "multiple_choice", "A") for t in (0, 1) for r in (0, 1) for role in fusion.ROLES]
    fused = jobs.fuse(spark.createDataFrame(data, kind), trials=2)
    assert [(r.trial, r.accuracy) for r in fused.trials.orderBy("trial").collect()] == [(0, 1.0), (1, 0.0)]
    assert {r.metric: r["mean"] for r in fused.summary.collect()}["accuracy"] == 0.5
    assert fused.decisions.count() == 2
    with pytest.raises(Exception, match="not complete"):
        jobs.fuse(spark.createDataFrame(data, kind), trials=3).trials.collect()
    with pytest.raises(Exception, match="not complete"):
        jobs.fuse(spark.createDataFrame([r for r in data if r[1] == 1], kind)).trials.collect()


def test_vote_of_many(spark):
    roles = ("direct", "b", "c", "d", "e")
    assert vote(spark, ["A", "B", "C", "D", "B"], roles).decision.answer == "B"
    assert vote(spark, ["A", "B", "C", "D", None], roles).decision.vote_count == 1
    with pytest.raises(Exception, match="more than one majority"):
        vote(spark, ["A", "A", "B", "B", "C"], roles)
    with pytest.raises(ValueError):
        fusion.majority_vote(spark.range(1), roles=("x", "y"))


def test_round_lattice_with_two_samples(spark):
    data = []
    for sample, gold in ((1, "A"), (2, "B")):
        for role, first, second in (("direct", gold, "C"), ("evidence", gold, "D"), ("verification", "D", gold if sample == 1 else "D")):
            for r, a in enumerate((first, second)):
                data.append((sample, r, role, a, True, a == gold, False, "multiple_choice", gold))
    df = spark.createDataFrame(
        data, "k int, round int, role string, answer string, parsed boolean, correct boolean, truncated boolean, task_type string, gold string"
    )
    decided = fusion.majority_vote(fusion.align_roles(df.repartition(7), ["k", "round"]))
    out = {r["round"]: r for r in fusion.fusion_metrics(decided, ["round"]).collect()}
    assert (out[0].accuracy, out[1].accuracy) == (1.0, 0.0)
    assert out[1].oracle_any_role_accuracy == 0.5
    assert out[0].majority_coverage + out[0].fallback_rate == 1.0


def test_empty_groups_have_zero_rates(spark):
    empty = spark.createDataFrame([], "k int, correct boolean, parsed boolean, truncated boolean, trial int")
    trials = spark.createDataFrame([(0,), (1,)], "trial int")
    assert rows(metrics.trial_scores(empty, trials, ["trial"]))[1][1:] == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_summary_of_one_trial(spark):
    one = metrics.summarize(spark.createDataFrame([(1, 0.5)], "g int, v double"), ["g"], "v").first()
    assert (one["mean"], one.sample_std, one.standard_error) == (0.5, 0.0, 0.0)


REWARDS = "natural double, guided_positive double, guided_negative double"


@pytest.mark.parametrize(
    "rewards, epsilon, case",
    [
        ((0.2, 0.9, 0.1), 0.6, preference.POSITIVE_CASE), ((0.6, 1.0, 0.0), 0.4, preference.POSITIVE_CASE),
        ((0.8, 0.9, 0.1), 0.6, preference.NEGATIVE_CASE), ((0.5, 0.6, 0.4), 0.6, None),
        ((0.3, 0.9, 0.3), 0.6, preference.POSITIVE_CASE),
    ],
)
def test_eq5(spark, rewards, epsilon, case):
    out = preference.select_pairs(spark.createDataFrame([rewards], REWARDS), epsilon).first()
    assert out.case_type == case and out.selected is (case is not None)


def test_eq5_rejects_bad_rewards(spark):
    with pytest.raises(Exception, match="reward must be in"):
        preference.select_pairs(spark.createDataFrame([(1.5, 0.0, 0.0)], REWARDS)).collect()
    with pytest.raises(ValueError):
        preference.select_pairs(spark.createDataFrame([(0.5, 0.0, 0.0)], REWARDS), 2.0)


def test_rollout_count_is_guarded(spark):
    data = [("s", "natural", i, i == 0) for i in range(2)]
    df = spark.createDataFrame(data, "s string, candidate string, rollout int, correct boolean")
    assert preference.rollout_rewards(df, ["s", "candidate"], 2).first().reward == 0.5
    with pytest.raises(Exception, match="rollouts, not 3"):
        preference.rollout_rewards(df, ["s", "candidate"], 3).collect()
    empty = spark.createDataFrame([("s", "natural"), ("s", "guided_positive")], "s string, candidate string")
    with pytest.raises(Exception, match="has 0 rollouts"):
        preference.rollout_rewards(df, ["s", "candidate"], 2, empty).collect()


def test_blank_candidate_wins_over_equal_texts(spark):
    texts = {"text_natural": ("p", "a"), "text_guided_positive": ("p", " a "), "text_guided_negative": ("p", "x")}
    base = spark.createDataFrame([(0.1, 0.9, 0.1)], REWARDS)
    for name, (prompt, response) in texts.items():
        base = base.withColumn(name, F.struct(F.lit(prompt).alias("prompt"), F.lit(response).alias("response")))
    same = preference.drop_invalid(preference.select_pairs(base)).first()
    assert (same.drop_reason, same.eq5_threshold_passed, same.selected) == (preference.IDENTICAL_TEXT, True, False)
    blank = base.withColumn("text_guided_negative", F.struct(F.lit("p").alias("prompt"), F.lit(" ").alias("response")))
    out = preference.drop_invalid(preference.select_pairs(blank)).first()
    assert (out.drop_reason, out.invalid_candidate_keys) == (preference.EMPTY_CANDIDATE, ["guided_negative"])


def test_candidate_maps_need_exact_keys(spark):
    good = {"natural": "a", "guided_positive": "b", "guided_negative": "c"}
    df = spark.createDataFrame([(1, good)], "k int, candidates map<string,string>")
    assert [r.value for r in preference.stack_candidates(df, ["k"]).orderBy("cand_idx").collect()] == ["a", "b", "c"]
    bad = spark.createDataFrame([(1, {**good, "more": "d"})], "k int, candidates map<string,string>")
    with pytest.raises(Exception, match="invalid candidate keys"):
        preference.stack_candidates(bad, ["k"]).collect()


def test_round_zero_counts_as_unknown(spark):
    df = spark.createDataFrame([("a", "s1", 0), (None, "", 2)], "case_type string, sample_id string, round int")
    out = {(r.section, r.name): (r.pairs, r.samples_with_pairs) for r in preference.pair_summary(df).collect()}
    assert out[("round", "unknown")] == (1, 1) and out[("case", "unknown")] == (1, 0) and out[("total", "all")] == (2, 1)


def test_matched_rows_need_every_role(spark):
    data = []
    for sample in (0, 1):
        for role in fusion.ROLES:
            for t in (0.2, 0.7):
                ok = not (sample == 1 and role == "verification")
                data.append((sample, f"s{sample}", role, t, "v", "p", "text", "A", ok, False))
    schema = (
        "sample_index int, sample_id string, role string, temperature double, prompt_version string, prompt string, "
        "response string, answer string, correct boolean, truncated boolean"
    )
    out = sft.matched_rows(spark.createDataFrame(data, schema), (0.7, 0.2)).collect()
    assert {(r.sample_id, r.role, r.temperature) for r in out} == {("s0", r, 0.7) for r in fusion.ROLES}


def test_retries(spark):
    data = [("a", 0, " "), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, ""), ("b", 1, " ")]
    out = records.resolve_retries(spark.createDataFrame(data, "k string, attempt int, response string"), ["k"])
    assert rows(out) == [("a", "x", 1, False), ("b", " ", 1, True)]


def test_percentiles_match_brute_force(spark):
    tokens = [(i * 37) % 101 for i in range(500)]
    df = spark.createDataFrame([(1024, t, None) for t in tokens], "max_tokens int, generated_tokens int, finish_reason string")
    out = lengths.percentiles(lengths.histogram(df)).filter("max_tokens is null").first()
    ordered = sorted(tokens)
    for q, got in ((0.5, out.generated_tokens_p50), (0.95, out.generated_tokens_p95), (0.99, out.generated_tokens_p99)):
        assert got == ordered[max(1, -(-500 * q // 1).__int__()) - 1]


def test_length_gate(spark):
    df = spark.createDataFrame([(10, 10, None)] * 3 + [(10, 10, "stop")], "max_tokens int, generated_tokens int, finish_reason string")
    out = lengths.assessment(lengths.percentiles(lengths.histogram(df)))
    assert {r.status for r in out.collect()} == {"fail"}
    assert out.filter("max_tokens = 10").first().recommended_max_tokens == 128
    with pytest.raises(RuntimeError):
        lengths.enforce(out, True)


def test_reports(spark):
    with pytest.raises(ValueError):
        baselines.som_scores(spark.range(1), [], 3)
    one = spark.createDataFrame([("m", "d", "current", 0.5)], "model string, dataset string, method string, accuracy double")
    with pytest.raises(Exception, match="cannot compare"):
        report.method_delta(one, ["model", "dataset"]).collect()
    odd = spark.createDataFrame([("m", "nope")], "model string, variant string")
    assert report.unknown_variants(odd).count() == 1
