"""Guidance targets: the right label to show, and repeatable wrong ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.matching import vote_label
from plenum.functions.seeds import joined
from plenum.functions.text import content_hash, hex_number, letters_for, strip, to_number

# Labels used when a question lists no choices, and number offsets.
DEFAULT_LABELS = ("A", "B", "C", "D")
OFFSETS = (-1, 1, 2, -2, 3, -3)


def usable_labels(labels: Column, choices: Column) -> Column:
    """The given labels, or A, B, ... when their number differs from the choices."""
    same = F.coalesce(F.size(labels) == F.size(choices), F.lit(False))
    return F.when(same, labels).otherwise(letters_for(choices))


def guidance_target(answer: Column, task: Column) -> Column:
    """Gold label in the wording of a guided prompt."""
    label = vote_label(answer, task)
    word = F.when(label == "YES", "Yes").when(label == "NO", "No")
    plain = strip(F.coalesce(label, answer, F.lit("")))
    return F.when(task == "yes_no", F.coalesce(word, plain)).otherwise(plain)


def pick(values: Column, *seed_parts) -> Column:
    """Element chosen by the first 8 bytes of the sha-256 of the seed text."""
    number = hex_number(content_hash(joined(*seed_parts)), 16)
    size = F.size(values).cast("decimal(20,0)")
    return F.element_at(values, (number % size).cast("int") + 1)


def wrong_target(
    answer: Column, task: Column, labels: Column, choices: Column, seed: int | None, sample_id: Column
) -> Column:
    """A label other than gold, stable for (seed, sample)."""
    gold = guidance_target(answer, task)
    wrong = F.filter(
        F.transform(usable_labels(labels, choices), strip),
        lambda x: (F.length(x) > 0) & (F.upper(x) != F.upper(gold)),
    )
    flipped = F.when(F.upper(gold).isin("YES", "Y"), "No").otherwise("Yes")
    chosen = F.when(F.size(wrong) > 0, pick(wrong, "None" if seed is None else seed, sample_id))
    failed = F.raise_error(F.lit("no wrong label can be built"))
    return F.when(task == "yes_no", flipped).otherwise(F.coalesce(chosen, failed))


def wrong_number(correct: Column, *seed_parts) -> Column:
    """A number other than the right one; an integer stays an integer if it can."""
    value = to_number(correct)
    draw = hex_number(content_hash(joined(*seed_parts)), 12).cast("bigint")
    step = F.element_at(F.array(*[F.lit(float(o)) for o in OFFSETS]), ((F.floor(draw / 4) % 6) + 1).cast("int"))
    share = (F.floor(draw / 4) % 1000) / F.lit(1000.0)
    is_int = ~correct.contains(".") & ~F.lower(correct).contains("e") & (value == F.floor(value))
    moved = (
        F.when(F.abs(value) < 1e-12, step)
        .when(draw % 4 == 0, -value)
        .when(draw % 4 == 1, F.round(value * (share * 0.4 + 1.1), 2))
        .when(draw % 4 == 2, F.round(value * (share * 0.4 + 0.5), 2))
        .otherwise(value + step)
    )
    safe = F.when(moved == value, value + 1).otherwise(moved)
    text = F.when(is_int & (safe == F.floor(safe)), safe.cast("bigint").cast("string")).otherwise(
        safe.cast("string")
    )
    return F.when(value.isNull(), "0").otherwise(text)


def wrong_answer(answer: Column, task: Column, choices: Column, *seed_parts) -> Column:
    """Flip yes/no, another label, another choice text, or another number."""
    correct = strip(answer)
    upper = F.upper(correct)
    letters = letters_for(choices)
    other_labels = F.filter(letters, lambda x: x != upper)
    other_texts = F.filter(choices, lambda x: F.upper(x) != upper)
    defaults = F.filter(F.array(*[F.lit(x) for x in DEFAULT_LABELS]), lambda x: x != upper)

    def one_of(values: Column) -> Column:
        return F.when(F.coalesce(F.size(values) > 0, F.lit(False)), pick(values, *seed_parts))

    by_label = F.when(upper.rlike("^[A-Z]$"), one_of(other_labels))
    return (
        F.when(task == "math", wrong_number(correct, *seed_parts))
        .when(upper == "YES", "no")
        .when(upper == "NO", "yes")
        .otherwise(F.coalesce(by_label, one_of(other_texts), one_of(defaults)))
    )


def first_wrong_letter(answer: Column, task: Column) -> Column:
    """Older fixed rule: flip yes/no, else the first of A to D that is not gold."""
    gold = F.upper(strip(F.coalesce(answer, F.lit(""))))
    return (
        F.when(task == "yes_no", F.when(gold.isin("YES", "Y"), "NO").otherwise("YES"))
        .when(task == "multiple_choice", F.when(gold == "A", "B").otherwise("A"))
        .otherwise("an incorrect alternative")
    )


