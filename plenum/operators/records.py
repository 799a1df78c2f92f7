"""From raw completions to scored rows, and between nested and flat shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.cleaning import unclosed_think, with_clean_response
from plenum.functions.extraction import with_extracted
from plenum.functions.matching import answers_match, task_or_default, vote_label
from plenum.functions.text import flag, present
from plenum.operators.ranking import numbers_first

# Finish reasons that are no length cut.
FINISHED_REASONS = ("stop", "abort")


def length_truncated(reason: Column, tokens: Column, limit: Column) -> Column:
    """Cut off by length: said so, or at the limit without another reason."""
    other = F.coalesce(reason.isin(*FINISHED_REASONS), F.lit(False))
    return F.coalesce(reason == "length", F.lit(False)) | F.coalesce(
        (tokens >= limit) & ~other, F.lit(False)
    )


def with_answer(
    df: DataFrame, text: str, task: str, gold: str, cleaned: str = "response"
) -> DataFrame:
    """Clean, extract, normalize and score: response, answer, answer_source,
    parse_confidence, parsed, correct."""
    known = df.withColumn("__task", task_or_default(F.col(task)))
    out = with_extracted(with_clean_response(known, text, cleaned), cleaned, "__task", "__x")
    found = F.col("__x.answer")
    return (
        out.withColumn("answer", F.coalesce(vote_label(found, F.col("__task")), found))
        .withColumn("answer_source", F.col("__x.source"))
        .withColumn("parse_confidence", F.col("__x.confidence"))
        .withColumn("parsed", found.isNotNull())
        .withColumn("correct", answers_match(found, F.col(gold), F.col("__task")))
        .drop("__x", "__task")
    )


def completion_record(
    df: DataFrame,
    text: str,
    task: str,
    gold: str,
    reason: str | None = None,
    tokens: str | None = None,
    limit: str | None = None,
) -> DataFrame:
    """``with_answer`` plus truncation flags from generation metadata."""
    none = F.lit(None)
    cut = length_truncated(
        F.col(reason) if reason else none.cast("string"),
        F.col(tokens) if tokens else none.cast("int"),
        F.col(limit) if limit else none.cast("int"),
    )
    open_think = unclosed_think(F.col(text))
    return with_answer(
        df.withColumn("length_truncated", cut)
        .withColumn(
            "truncation_reason",
            F.when(cut, "max_tokens").when(open_think, "unclosed_think"),
        )
        .withColumn("truncated", F.col("truncation_reason").isNotNull()),
        text,
        task,
        gold,
    )


def flatten_rounds(records: DataFrame, keep: list[str], agent: str = "actor") -> DataFrame:
    """One row per round: the completion fields that scoring reads.

    Each field is an array beside the others: of a stored table only the fields that are
    asked for are read, and the number of rounds is not looked at first, as for ``explode``.
    """
    completion = F.col("rounds")[agent]["completion"]
    fields = ("answer", "parsed", "correct", "truncated")
    aside = records.select(*keep, F.col("rounds")["round"].alias("__round"), *[completion[c].alias(f"__{c}") for c in fields])
    every = aside.select("*", F.posexplode_outer("__round").alias("__at", "round")).filter("__at is not null")
    answer, *flags = (F.get(f"__{c}", F.col("__at")) for c in fields)
    return every.select(*keep, "round", answer.alias("answer"), *[flag(value).alias(c) for value, c in zip(flags, fields[1:])])


def last_round(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The row of the highest round per key."""
    best = F.max_by(F.struct("round", *values), F.col("round")).alias("__last")
    return rows.groupBy(*numbers_first(rows, keys)).agg(best).select(*keys, "__last.*")


def resolve_retries(
    attempts: DataFrame, keys: list[str], attempt: str = "attempt", response: str = "response"
) -> DataFrame:
    """Per request the first non-empty attempt, else the last one."""
    blank = ~present(F.col(response))
    order = F.struct(
        blank.alias("blank"), F.when(blank, -F.col(attempt)).otherwise(F.col(attempt)).alias("at")
    )
    kept = F.min_by(F.struct(attempt, response), order).alias("__kept")
    return (
        attempts.groupBy(*keys)
        .agg(kept)
        .select(
            *keys,
            F.col(f"__kept.{response}").alias(response),
            F.col(f"__kept.{attempt}").alias("empty_response_retries"),
            (~present(F.col(f"__kept.{response}"))).alias("empty_response_exhausted"),
        )
    )


def usable(rows: DataFrame, response: str = "response", truncated: str = "truncated") -> DataFrame:
    """Rows with visible text that was not cut off."""
    return rows.filter(usable_flag(F.col(response), F.col(truncated)))


def usable_flag(response: Column, truncated: Column) -> Column:
    return present(response) & ~flag(truncated)
