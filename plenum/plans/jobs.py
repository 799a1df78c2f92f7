"""The jobs: chains of operators over the caller's tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match
from plenum.operators import audit, fusion, metrics, preference, quality, records, sft

KEYS = ["dataset", "sample_index", "round"]
# Metrics that a job of several trials summarizes.
SUMMARIZED = (
    "accuracy", "parse_rate", "majority_coverage", "majority_conditional_accuracy", "fallback_accuracy",
    "oracle_any_actor_accuracy", *[f"{role}_accuracy" for role in fusion.ROLES],
)


def whole_series(rows: DataFrame, groups: list[str], number: str, count: int | None = None) -> DataFrame:
    """The metric rows, if each group has the numbers 0..n-1 over equally many samples.

    Otherwise the job fails with the group's name.
    """
    every = Window.partitionBy(*groups)  # one row per round or trial
    size = F.count(F.lit(1)).over(every)
    fits = (
        (F.min(number).over(every) == 0) & (F.max(number).over(every) == size - 1)
        & (F.min("samples").over(every) == F.max("samples").over(every))
    )
    if count is not None:
        fits = fits & (size == count)
    message = F.concat(F.lit(f"{number}s are not complete: "), F.to_json(F.struct(*groups)))
    checked = rows.withColumn("__fits", fits)
    return checked.filter(F.when(F.col("__fits"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("__fits")


def round_lattice(
    completions: DataFrame, text: str = "raw_response", reparse: bool = True, rounds: int | None = None
) -> DataFrame:
    """Answers of all roles to decision metrics and pair agreement per data set and round.

    Columns: dataset, sample_index, round, role, task_type, gold, truncated and
    the text; without ``reparse`` the stored answer and parsed are taken.
    Every role must be there once per key, and every round cover the samples.
    """
    if reparse:
        scored = records.with_answer(completions, text, "task_type", "gold")
    else:
        hit = answers_match(F.col("answer"), F.col("gold"), F.col("task_type"))
        scored = completions.withColumn("correct", hit)
    decided = fusion.majority_vote(fusion.align_roles(scored, KEYS))
    return whole_series(fusion.fusion_metrics(decided, ["dataset", "round"], pairs=True), ["dataset"], "round", rounds)


class Fused(NamedTuple):
    decisions: DataFrame
    trials: DataFrame
    summary: DataFrame


def fuse(role_rounds: DataFrame, trials: int | None = None) -> Fused:
    """Answered rows of all rounds to decisions, metrics per trial and their summary.

    The last round of each (data set, trial, sample, role) counts.  Roles must
    be aligned, trials 0..n-1 (``trials`` of them where given) over equally
    many samples.
    """
    keys = ["dataset", "trial", "sample_index"]
    values = ["task_type", "gold", "answer", "parsed", "correct", "truncated"]
    final = records.last_round(role_rounds, [*keys, "role"], values)
    decided = fusion.majority_vote(fusion.align_roles(final, keys))
    votes = [f"vote_{role}" for role in fusion.ROLES]
    decisions = decided.select(*keys, "task_type", F.col("gold").alias("gold_answer"), *votes, "decision.*", F.col("decision_correct").alias("correct"))
    scored = fusion.fusion_metrics(decided, ["dataset", "trial"], oracle_name="oracle_any_actor_accuracy")
    per_trial = whole_series(scored, ["dataset"], "trial", trials)
    long = audit.long_form(per_trial, ["dataset", "trial"], list(SUMMARIZED))
    return Fused(decisions, per_trial, metrics.summarize(long, ["dataset", "metric"], "value"))


class Evaluated(NamedTuple):
    violations: DataFrame
    rounds: DataFrame
    summary: DataFrame


def evaluate(
    nested: DataFrame, keep: Sequence[str], samples: DataFrame, rounds: int = 5, trials: int = 5,
    reference: DataFrame | None = None, tolerance: float = audit.POINT_TOLERANCE,
) -> Evaluated:
    """Nested records of several trials: all contract checks, scores by round, summary of the last round.

    ``keep`` are the group columns, ``samples`` the (sample_id) every group and
    trial must cover, ``reference`` published (keep, mean) values.  Violations
    have (check, key); the summary carries the reference and whether it is met.
    """
    groups = [*keep, "trial"]
    name = F.concat_ws("/", *[F.col(g).cast("string") for g in groups])

    def found(check: str, rows: DataFrame, key) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), key.alias("key"))

    cells = F.broadcast(nested.select(*groups).distinct())  # a row per group and trial, as in the scores
    expected = samples.select(*keep, "sample_id").join(cells, list(keep))
    covered = quality.coverage(nested, expected, [*groups, "sample_id"])
    contiguous = nested.withColumn("__key", F.concat_ws("/", name, "sample_id"))
    violations = (
        found("rounds", quality.rounds_not_contiguous(contiguous, "__key", count=rounds), F.col("__key"))
        .unionByName(found("duplicates", quality.duplicate_ids(nested, "sample_id", groups), F.concat_ws("/", name, "sample_id")))
        .unionByName(covered.select(F.col("problem").alias("check"), F.concat_ws("/", name, "sample_id").alias("key")))
        .unionByName(found("trials", quality.trials_not_contiguous(nested, list(keep), "sample_id"), F.concat_ws("/", *keep)))
        .unionByName(
            found(
                "trial count",
                nested.groupBy(*keep).agg(F.countDistinct("trial").alias("n")).filter(F.col("n") != trials),
                F.concat_ws("/", *keep),
            )
        )
    )
    scores = metrics.score_counts(records.flatten_rounds(nested, groups), [*groups, "round"])
    summary = metrics.summarize(scores.filter(F.col("round") == rounds - 1), list(keep), "accuracy")
    if reference is not None:
        known = reference.select(*keep, F.col("mean").alias("reference"))
        gap = F.abs(F.col("mean") - F.col("reference"))
        summary = summary.join(known, list(keep), "left").withColumn("reproduced", F.coalesce(gap <= tolerance, F.lit(False)))
    return Evaluated(violations, scores, summary)


def preference_data(
    rollouts: DataFrame, candidates: DataFrame, agent: str, iteration: int, expected: int, prompt_version: str
) -> tuple[DataFrame, DataFrame]:
    """Audited rounds and the pair table of one agent."""
    keys = ["sample_id", "sample_index", "round"]
    rounds = preference.preference_rounds(rollouts, candidates, keys, expected)
    return rounds, preference.materialize_pairs(rounds, agent, iteration, expected, prompt_version)


def balanced_sft(candidates: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """Candidates to one checked row per role on the common samples."""
    rows = sft.matched_rows(candidates, temperatures)
    quality.enforce(quality.unbalanced_roles(rows), "role balance")
    return rows
