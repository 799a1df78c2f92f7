"""Baseline protocols: direct answers, two-agent debate, several equal agents."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match
from plenum.functions.text import flag, ratio
from plenum.operators.fusion import plurality_unique
from plenum.operators.metrics import score_counts
from plenum.operators.ranking import numbers_first

# Protocol constants.
ROUNDS = 5
AGENT_COUNTS = (2, 4)


def direct_from_debate(records: DataFrame, keep: list[str], rounds: str = "rounds") -> DataFrame:
    """Round-0 actor text of debate records, which must hold rounds 0..4.

    Only the first round is read from the array; the truncation flag comes
    from the stored row, the answer is parsed again later.
    """
    whole = (F.size(rounds) == ROUNDS) & (F.get(rounds, F.lit(0))["round"] == 0)
    first = F.get(rounds, F.lit(0))["actor"]["completion"]
    text = F.coalesce(first["raw_response"], first["response"], F.lit(""))
    failed = F.raise_error(F.lit("debate record without rounds 0..4"))
    return records.select(
        *keep,
        F.when(whole, text).otherwise(failed).alias("raw_response"),
        flag(first["truncated"]).alias("stored_truncated"),
    )


def direct_scores(rows: DataFrame, groups: list[str]) -> DataFrame:
    return score_counts(rows, groups)


def debate_scores(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Scores per round; ``headline`` marks the last round."""
    return score_counts(rows, [*groups, "round"]).withColumn(
        "headline", F.col("round") == ROUNDS - 1
    )


def som_scores(rows: DataFrame, groups: list[str], agents: int, sample: str = "sample_index") -> DataFrame:
    """Per round: mean agent rates, and the vote where one answer is on top.

    The headline accuracy is the mean over agents, not the vote.  Gold and task come with
    the tally, so votes of a sample are grouped where the sample is, without a join; rows
    with a null in a key have no vote.
    """
    if agents not in AGENT_COUNTS:
        raise ValueError(f"supports {AGENT_COUNTS} agents, got {agents}")
    keys = [*groups, "round"]
    per_agent = score_counts(rows, keys).select(
        *keys,
        F.col("samples").alias("agent_decisions"),
        F.col("accuracy").alias("mean_agent_accuracy"),
        F.col("parse_rate").alias("mean_agent_parse_rate"),
        F.col("truncation_rate").alias("mean_agent_truncation_rate"),
    )
    # numbers first: the sorts compare the sample before anything else
    by_sample = numbers_first(rows, [sample, *keys])
    whole = reduce(and_, [F.col(k).isNotNull() for k in by_sample])
    votes = plurality_unique(rows.filter(whole), by_sample, "agent", shared=("gold", "task_type"))
    resolved = F.col("prediction").isNotNull()
    hit = resolved & answers_match(F.col("prediction"), F.col("gold"), F.col("task_type"))
    per_vote = votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        ratio(F.count_if(hit), F.count(F.lit(1))).alias("plurality_vote_accuracy"),
        ratio(F.count_if(resolved), F.count(F.lit(1))).alias("plurality_vote_coverage"),
    )
    return per_agent.join(per_vote, keys)
