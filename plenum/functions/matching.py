"""Answer labels for voting, for matching and for the decision audit.

Three normalizers exist on purpose: voting keeps whole labels, matching looks
at the first character, the audit strips in another order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import let, strip, to_number

# Words accepted as yes and no.
YES_WORDS = ("YES", "Y")
NO_WORDS = ("NO", "N")


def _yes_no(label: Column, yes: str, no: str) -> Column:
    return F.when(label.isin(*YES_WORDS), F.lit(yes)).when(label.isin(*NO_WORDS), F.lit(no))


def _single_letter(label: Column) -> Column:
    return F.when(label.rlike("^[A-Z]$"), label)


def _letter(text: Column) -> Column:
    """True for one letter A to Z: its own label under every rule, so that most rows skip the rules."""
    return (F.octet_length(text) == 1) & text.between("A", "Z")


def _vote_label(label: Column, task: Column, other: Column) -> Column:
    return (
        F.when(task == "yes_no", _yes_no(label, "YES", "NO"))
        .when(task == "multiple_choice", _single_letter(label))
        .when(task == "mixed", F.coalesce(_single_letter(label), _yes_no(label, "YES", "NO")))
        .otherwise(other)
    )


def vote_label(answer: Column, task: Column) -> Column:
    """Label used for votes and agreement; NULL when it is no valid label."""
    def shape(text: Column) -> Column:
        label = F.upper(F.btrim(F.btrim(text, F.lit("().")), F.lit(".")))
        return F.when(F.length(text) > 0, _vote_label(label, task, text))

    plain = F.when(task.isin("multiple_choice", "mixed") & _letter(answer), answer).when(
        (task == "yes_no") & answer.isin("YES", "NO"), answer
    )
    return plain.otherwise(let(strip(answer), shape))


def audit_label(answer: Column, task: Column) -> Column:
    """Label of the decision audit; math has none (see ``audit_task_known``)."""
    def shape(label: Column) -> Column:
        return _vote_label(label, task, F.lit(None).cast("string"))

    plain = F.when(task.isin("multiple_choice", "mixed") & _letter(answer), answer).when(
        (task == "yes_no") & answer.isin("YES", "NO"), answer
    )
    return plain.otherwise(let(F.upper(strip(F.btrim(strip(answer), F.lit("().")))), shape))


def match_label(answer: Column, task: Column) -> Column:
    """Y / N or the first character, upper-cased; '' for a missing answer."""
    text = strip(F.coalesce(answer, F.lit("")))

    def shape(label: Column) -> Column:
        first = F.substring(label, 1, 1)
        word = F.when(task.isin("yes_no", "mixed"), _yes_no(label, "Y", "N"))
        return F.coalesce(word, first)

    plain = F.when(_letter(answer) | answer.isin("YES", "NO"), F.substring(answer, 1, 1))
    return plain.otherwise(let(F.upper(F.btrim(F.btrim(text, F.lit("()")), F.lit("."))), shape))


_TEXT_WRAPPER = r"(?d)^\\text\{(.+)\}$"
_FRACTION = r"(?d)^\\d?frac\{(.+?)\}\{(.+?)\}$"


def _math_value(answer: Column) -> Column:
    """struct(number, text): the number when there is one, else squeezed text."""
    def unwrap(text: Column) -> Column:
        inner = F.regexp_extract(text, _TEXT_WRAPPER, 1)
        return F.when(F.length(inner) > 0, strip(inner)).otherwise(text)

    def shape(text: Column) -> Column:
        top = to_number(F.regexp_extract(text, _FRACTION, 1))
        bottom = to_number(F.regexp_extract(text, _FRACTION, 2))
        fraction = F.try_divide(top, bottom)
        return F.struct(
            F.coalesce(fraction, to_number(text)).alias("number"),
            F.regexp_replace(text, r"(?U)\s+", " ").alias("text"),
        )

    return let(let(strip(answer), unwrap), shape)


def math_equal(left: Column, right: Column) -> Column:
    """Equal as text, or as numbers within 1e-6."""
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))

    def compare(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        numeric = F.abs(x["number"] - y["number"]) < 1e-6
        both_text = x["number"].isNull() & y["number"].isNull()
        return F.coalesce(
            (x["number"] == y["number"]) | numeric, both_text & (x["text"] == y["text"])
        )

    close = let(F.struct(_math_value(a).alias("x"), _math_value(b).alias("y")), compare)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), a == b).otherwise(close)


def answers_match(answer: Column, gold: Column, task: Column) -> Column:
    """Prediction equals gold under the rule of the task (two blanks match)."""
    return F.when(task == "math", math_equal(answer, gold)).otherwise(
        match_label(answer, task) == match_label(gold, task)
    )


def task_or_default(task: Column, default: str = "multiple_choice") -> Column:
    return F.when(F.length(task) > 0, task).otherwise(F.lit(default))
