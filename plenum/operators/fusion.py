"""Fusing the answers of several roles and scoring the decisions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match, vote_label
from plenum.functions.text import flag, let, ratio
from plenum.operators.ranking import numbers_first

# The voting roles and the one asked when no two agree.
ROLES = ("direct", "evidence", "verification")
FALLBACK_ROLE = "direct"


def align_roles(
    rows: DataFrame,
    keys: list[str],
    values: Sequence[str] = ("answer", "parsed", "correct", "truncated"),
    shared: Sequence[str] = ("task_type", "gold"),
    roles: Sequence[str] = ROLES,
) -> DataFrame:
    """One row per key with a struct per role: one shuffle instead of n-1 joins.

    The job fails unless every key has exactly one row of each role and all of
    them carry the same shared columns (``alignment_problems`` lists such keys).
    Rows of other roles are left out.
    """
    counted = _counted_roles(rows, keys, shared, roles, [_of(r, *values).alias(r) for r in roles])
    message = F.concat(F.lit("roles are not aligned: "), F.to_json(F.struct(*keys)))
    whole = F.when(F.col("__problem").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return counted.filter(whole).select(*keys, "__shared.*", *roles)


def _of(role: str, *columns: str) -> Column:
    return F.max(F.when(F.col("role") == role, F.struct(*columns)))


def _counted_roles(
    rows: DataFrame, keys: list[str], shared: Sequence[str], roles: Sequence[str], more: Sequence[Column] = ()
) -> DataFrame:
    """Keys with ``__shared`` and ``__problem``: missing, repeated or different, else null."""
    facts = F.struct(*shared)
    counts = [F.count_if(F.col("role") == r).alias(f"__n{i}") for i, r in enumerate(roles)]
    out = rows.filter(F.col("role").isin(*roles)).groupBy(*numbers_first(rows, keys)).agg(
        F.min(facts).alias("__shared"), F.max(facts).alias("__other"), *counts, *more
    )
    numbers = [F.col(f"__n{i}") for i in range(len(roles))]
    problem = (
        F.when(F.least(*numbers) == 0, "missing")
        .when(F.greatest(*numbers) > 1, "repeated")
        .when(~F.col("__shared").eqNullSafe(F.col("__other")), "different")
    )
    return out.withColumn("__problem", problem)


def alignment_problems(
    rows: DataFrame, keys: list[str], shared: Sequence[str] = ("task_type", "gold"), roles: Sequence[str] = ROLES
) -> DataFrame:
    """(keys, problem) where a role is missing or repeated, or shared columns differ."""
    counted = _counted_roles(rows, keys, shared, roles)
    return counted.filter("__problem is not null").select(*keys, F.col("__problem").alias("problem"))


def _vote_of_three(votes: list[Column], fallback: int, roles: Sequence[str]) -> Column:
    a, b, c = votes
    ab, ac, bc = flag(a == b), flag(a == c), flag(b == c)
    winner = F.when(ab | ac, a).when(bc, b)
    reached = ab | ac | bc
    return F.struct(
        F.coalesce(winner, votes[fallback]).alias("answer"),
        F.when(ab & bc, "unanimous")
        .when(reached, "majority")
        .otherwise("fixed_direct_fallback")
        .alias("source"),
        F.when(~reached, F.lit(roles[fallback])).alias("selected_role"),
        reached.alias("majority_reached"),
        F.when(ab & bc, 3)
        .when(reached, 2)
        .when(votes[fallback].isNotNull(), 1)
        .otherwise(0)
        .alias("vote_count"),
    )


def _vote_of_many(votes: list[Column], fallback: int, roles: Sequence[str]) -> Column:
    def decide(all_votes: Column) -> Column:
        valid = F.filter(all_votes, lambda x: x.isNotNull())
        tally = F.transform(
            F.array_distinct(valid),
            lambda label: F.struct(
                F.size(F.filter(valid, lambda x: x == label)).alias("n"), label.alias("label")
            ),
        )
        chosen = F.element_at(all_votes, fallback + 1)

        def settle(winners: Column) -> Column:
            top = F.get(winners, F.lit(0))
            reached = F.size(winners) == 1
            at_fallback = F.size(F.filter(valid, lambda x: x == chosen))
            return F.when(
                F.size(winners) > 1, F.raise_error(F.lit("more than one majority answer"))
            ).otherwise(
                F.struct(
                    F.when(reached, top["label"]).otherwise(chosen).alias("answer"),
                    F.when(reached & (top["n"] == len(votes)), "unanimous")
                    .when(reached, "majority")
                    .otherwise("fixed_direct_fallback")
                    .alias("source"),
                    F.when(~reached, F.lit(roles[fallback])).alias("selected_role"),
                    reached.alias("majority_reached"),
                    F.when(reached, top["n"]).otherwise(at_fallback).alias("vote_count"),
                )
            )

        return let(F.filter(tally, lambda t: t["n"] >= 2), settle)

    return let(F.array(*votes), decide)


def majority_vote(
    aligned: DataFrame,
    roles: Sequence[str] = ROLES,
    fallback: str = FALLBACK_ROLE,
    task: str = "task_type",
    gold: str | None = "gold",
) -> DataFrame:
    """Add the normalized votes, ``decision`` and ``decision_correct``.

    Two equal votes win; without them the fallback role decides alone.
    """
    if fallback not in roles:
        raise ValueError(f"fallback role {fallback!r} is not among the voters")
    out = aligned
    for role in roles:
        out = out.withColumn(f"vote_{role}", vote_label(F.col(f"{role}.answer"), F.col(task)))
    votes = [F.col(f"vote_{role}") for role in roles]
    vote = _vote_of_three if len(votes) == 3 else _vote_of_many
    out = out.withColumn("decision", vote(votes, list(roles).index(fallback), roles))
    if gold is not None:
        out = out.withColumn(
            "decision_correct", answers_match(F.col("decision.answer"), F.col(gold), F.col(task))
        )
    return out


def fusion_metrics(
    decided: DataFrame,
    groups: list[str],
    roles: Sequence[str] = ROLES,
    oracle_name: str = "oracle_any_role_accuracy",
    pairs: bool = False,
) -> DataFrame:
    """All decision counters and rates per group from one aggregation.

    ``pairs`` adds how often two roles agree, and agree on the gold answer.
    """
    correct = F.col("decision_correct")
    reached = F.col("decision.majority_reached")
    any_role = flag(F.col(f"{roles[0]}.correct"))
    for role in roles[1:]:
        any_role = any_role | flag(F.col(f"{role}.correct"))
    counters = {
        "samples": F.count(F.lit(1)),
        "correct": F.count_if(correct),
        "parsed": F.count_if(F.col("decision.answer").isNotNull()),
        "majority": F.count_if(reached),
        "majority_correct": F.count_if(reached & correct),
        "fallback": F.count_if(~reached),
        "fallback_correct": F.count_if(~reached & correct),
        "unanimous": F.count_if(F.col("decision.source") == "unanimous"),
        "oracle": F.count_if(any_role),
    }
    for role in roles:
        for field in ("correct", "parsed", "truncated"):
            counters[f"{role}_{field}"] = F.count_if(flag(F.col(f"{role}.{field}")))
    agreements = []
    for left, right in combinations(roles, 2) if pairs else ():
        agree = flag(F.col(f"vote_{left}") == F.col(f"vote_{right}"))
        match = answers_match(F.col(f"vote_{left}"), F.col("gold"), F.col("task_type"))
        counters[f"{left}_{right}_agree"] = F.count_if(agree)
        counters[f"{left}_{right}_agree_correct"] = F.count_if(agree & match)
        agreements += [f"{left}_{right}_agree", f"{left}_{right}_agree_correct"]
    totals = decided.groupBy(*groups).agg(*[c.alias(n) for n, c in counters.items()])

    def share(part: str, whole: str = "samples") -> Column:
        return ratio(F.col(part), F.col(whole))

    rates = [
        share("correct").alias("accuracy"),
        share("parsed").alias("parse_rate"),
        share("majority").alias("majority_coverage"),
        share("majority_correct", "majority").alias("majority_conditional_accuracy"),
        share("fallback").alias("fallback_rate"),
        share("fallback_correct", "fallback").alias("fallback_accuracy"),
        share("unanimous").alias("unanimous_rate"),
        share("oracle").alias(oracle_name),
    ]
    for role in roles:
        rates += [
            share(f"{role}_correct").alias(f"{role}_accuracy"),
            share(f"{role}_parsed").alias(f"{role}_parse_rate"),
            share(f"{role}_truncated").alias(f"{role}_truncation_rate"),
        ]
    return totals.select(*groups, "samples", "correct", *rates, *agreements)


def pair_rows(decided: DataFrame, keep: list[str], roles: Sequence[str] = ROLES) -> DataFrame:
    """One row per unordered role pair and key: agree, agree_correct.

    Works on aligned columns, so no self join and no pairs of rows are formed.
    """
    pairs = []
    for left, right in combinations(roles, 2):
        agree = flag(F.col(f"vote_{left}") == F.col(f"vote_{right}"))
        match = answers_match(F.col(f"vote_{left}"), F.col("gold"), F.col("task_type"))
        pairs.append(
            F.struct(
                F.lit(f"{left}+{right}").alias("pair"),
                agree.alias("agree"),
                (agree & match).alias("agree_correct"),
            )
        )
    return decided.select(*keep, F.explode(F.array(*pairs)).alias("__p")).select(*keep, "__p.*")


def pair_agreement(
    decided: DataFrame, groups: list[str], roles: Sequence[str] = ROLES
) -> DataFrame:
    """Agreement counts, coverage and conditional accuracy per role pair."""
    totals = (
        pair_rows(decided, groups, roles)
        .groupBy(*groups, "pair")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if("agree").alias("agree"),
            F.count_if("agree_correct").alias("agree_correct"),
        )
    )
    return totals.select(
        *groups,
        "pair",
        "agree",
        "agree_correct",
        ratio(F.col("agree"), F.col("samples")).alias("coverage"),
        ratio(F.col("agree_correct"), F.col("agree")).alias("conditional_accuracy"),
    )


def answer_tally(rows: DataFrame, keys: list[str], order: str = "role_idx", shared: Sequence[str] = ()) -> DataFrame:
    """Votes per key and normalized answer with the first voter's position.

    Blank and missing answers are one row with a null label and no votes, so a
    key without any vote is still there.  The greatest of each ``shared`` column comes along.
    """
    label = vote_label(F.col("answer"), F.col("task_type"))
    return (
        rows.withColumn("label", F.when(F.length(label) > 0, label))
        .groupBy(*keys, "label")
        .agg(F.count("label").alias("votes"), F.min(order).alias("first_seen"), *[F.max(c).alias(c) for c in shared])
    )


def plurality_first(rows: DataFrame, keys: list[str], order: str = "role_idx") -> DataFrame:
    """Most common answer, ties by first seen; at least two votes decide."""
    best = F.max_by(F.struct("label", "votes"), F.struct(F.col("votes"), -F.col("first_seen")))
    top = answer_tally(rows, keys, order).groupBy(*keys).agg(best.alias("__b"))
    count = F.col("__b.votes")
    return top.select(
        *keys,
        F.when(count >= 2, "majority").otherwise("judge").alias("source"),
        F.when(count >= 2, F.col("__b.label")).alias("final_answer"),
        F.col("__b.label").alias("majority_answer"),
        count.alias("majority_count"),
    )


def plurality_unique(rows: DataFrame, keys: list[str], order: str = "role_idx", shared: Sequence[str] = ()) -> DataFrame:
    """Most common answer if it is the single top one, else NULL, and the greatest of each ``shared`` column of the key."""
    greatest = [F.max(c).alias(c) for c in shared]
    top = (
        answer_tally(rows, keys, order, shared)
        .groupBy(*keys, "votes")
        .agg(F.count(F.lit(1)).alias("ties"), F.min("label").alias("label"), *greatest)
        .groupBy(*keys)
        .agg(F.max_by(F.struct("ties", "label"), F.col("votes")).alias("__b"), *greatest)
    )
    return top.select(*keys, F.when(F.col("__b.ties") == 1, F.col("__b.label")).alias("prediction"), *shared)


def transition_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Correctness in the first, second and last round of each key."""
    def at(round_: int) -> Column:
        return F.bool_or(F.when(F.col("round") == round_, F.col("correct")))

    return (
        rows.groupBy(*keys)
        .agg(
            at(0).alias("first_correct"),
            at(1).alias("second_correct"),
            F.max_by("correct", "round").alias("last_correct"),
            F.count(F.lit(1)).alias("__rounds"),
        )
        .filter(F.col("__rounds") > 1)
        .select(
            *keys,
            "first_correct",
            "second_correct",
            "last_correct",
            (~F.col("first_correct") & F.col("last_correct")).alias("corrected"),
            (F.col("first_correct") & ~F.col("last_correct")).alias("harmed"),
        )
    )


def round_transitions(rows: DataFrame, cell: list[str], key: str = "sample_index") -> DataFrame:
    """Wrong-to-right and right-to-wrong counts from round 0 to 1 and to the last.

    ``rows`` holds one (cell, key, round, correct) row per decision.
    """
    flips = transition_rows(rows, [*cell, key])

    def moved(after: str, gained: bool) -> Column:
        before, now = F.col("first_correct"), F.col(after)
        return F.count_if(~before & now if gained else before & ~now)

    totals = flips.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("samples"),
        moved("second_correct", True).alias("r0_wrong_r1_right"),
        moved("second_correct", False).alias("r0_right_r1_wrong"),
        moved("last_correct", True).alias("r0_wrong_last_right"),
        moved("last_correct", False).alias("r0_right_last_wrong"),
    )
    names = [c for c in totals.columns if c.startswith("r0_")]
    return totals.select(
        "*", *[(F.col(n) * 100.0 / F.col("samples")).alias(f"{n}_percent") for n in names]
    )
