import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plenum.functions import extraction
from plenum.functions.cleaning import unclosed_think, with_clean_response
from plenum.functions.extraction import with_extracted

# (task, text, answer, source or None when only the answer matters)
CASES = [
    ("yes_no", "The answer is Yes.", "YES", None),
    ("yes_no", "Final answer: No", "NO", "final_answer"),
    ("yes_no", "I think the answer is no.", "NO", None),
    ("yes_no", "Yes, that is correct.", "YES", "weak_tail"),
    ("yes_no", "NO", "NO", "weak_tail"),
    ("yes_no", "", None, "none"),
    ("yes_no", "   \n\t  ", None, "none"),
    ("yes_no", "The sky is blue.", None, "none"),
    ("yes_no", "**Final Answer:** Yes\n\nJustification: supported.", "YES", "final_answer"),
    ("yes_no", "**Answer:** Yes\n\n**Justification:** supported.", "YES", "tail_claim"),
    ("yes_no", "I conclude that:\n\n**Yes**\n\nJustification: supported.", "YES", "weak_tail"),
    ("yes_no", "No — the passage describes the opposite.", "NO", "weak_tail"),
    ("yes_no", "No matter which option we consider, the passage is ambiguous.", None, "none"),
    ("yes_no", "Yes or no questions require a binary answer.", None, "none"),
    ("yes_no", "Yes it could be, but actually No in the end.", "NO", None),
    ("yes_no", 'The answer to the question "Is it free?" is No.', "NO", "tail_claim"),
    ("yes_no", "The final answer is:\n\nB: No\n\nJustification follows.", "NO", "final_answer"),
    ("yes_no", "B (No)", "NO", "tail_claim"),
    ("yes_no", "Reasoning concludes here.\n(B)", "NO", "weak_tail"),
    ("yes_no", "B: The two objects are identical.", "NO", "weak_tail"),
    ("yes_no", "The final result is A.", "YES", "final_result"),
    ("yes_no", "Several peers chose B.\nFinal Answer: A: No", "NO", "final_answer"),
    ("yes_no", "Person A disagrees with Person B.", None, "none"),
    ("yes_no", " ".join(["word"] * 10000) + " The answer is Yes.", "YES", "tail_claim"),
    ("yes_no", "Final answer: Yes !@#$%^&*()_+-=[]{}|;':\",./<>?", "YES", "final_answer"),
    ("multiple_choice", "The answer is (A).", "A", "tail_claim"),
    ("multiple_choice", "I'd choose (B) because", "B", "tail_claim"),
    ("multiple_choice", "the most likely diagnosis is:\n\n(C) foo", "C", "tail_claim"),
    ("multiple_choice", "it was the Quakers (C).", "C", "weak_tail"),
    ("multiple_choice", "<think>The final result is A.</think>\nThe final result is C.", "C", "final_result"),
    ("multiple_choice", "The final result is A.\n</think>\nThe final result is C.", "C", "final_result"),
    ("multiple_choice", "<think>The answer is A and then", None, "none"),
    ("multiple_choice", "Visible.\n<think>The final result is A and stop", None, "none"),
    ("multiple_choice", "Final Answer: R", "R", "final_answer"),
    ("multiple_choice", "Final Answer: S", None, None),
    ("multiple_choice", "The answer is ((A)).", "A", None),
    ("multiple_choice", "The answer is wrong.", None, None),
    ("multiple_choice", "The answer is <option letter>.\n\nThe final result is <(c)>.", "C", "final_result"),
    ("mixed", "The answer is (A).", "A", None),
    ("mixed", "The answer is Yes.", "YES", None),
    ("math", "so \\boxed{\\frac{1}{2}} ok", "\\frac{1}{2}", "boxed"),
    ("math", "\\boxed{1} and \\boxed{2", "1", "boxed"),
    ("math", "\\boxed{}\nFinal answer: 3", None, "none"),
    ("math", "The final answer is 42 because foo", "42", "final_answer"),
    ("math", "so it equals 7.", "7", "weak_tail"),
    ("math", "a = 12", "12", "tail_claim"),
    ("bad", "The answer is (A).", None, "none"),
]


def test_extraction_cases(spark):
    data = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(data, "i int, task string, t string, e string, s string")
    out = with_extracted(with_clean_response(df, "t", "c"), "c", "task").collect()
    assert len(out) == len(CASES)
    for row in out:
        assert row.extracted.answer == row.e, row.t[:80]
        assert row.s is None or row.extracted.source == row.s, row.t[:80]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("A\n\na \n\nB", "A\n\nB"),
        ("Text\r\n\r\n/no_think\r\nmore", "Text\n\nmore"),
        ("Answer: <your answer>\n\nReal text.", "Real text."),
        ("Answer: <your answer>", ""),
        ("It is <B> , yes", "It is B, yes"),
        ("Keep this. The answer is", "Keep this."),
        ("Size <4 cm> ok", "Size 4 cm ok"),
        ("a  \t b\n\n\n\n\nc", "a b\n\nc"),
        (None, ""),
    ],
)
def test_cleaning(spark, raw, cleaned):
    df = spark.createDataFrame([(raw,)], "t string")
    assert with_clean_response(df, "t", "c").first()["c"] == cleaned


def test_unclosed_think(spark):
    texts = ["<think>a</think> b", "a <THINK x>b", "b </think>", None, "<thinking>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.withColumn("u", unclosed_think(F.col("t"))).orderBy("i").collect()]
    assert got == [False, True, False, False, False]


@pytest.mark.parametrize("text, span", [("{\\boxed{7}}", "{\\boxed{7}"), ("Boxed {8}", "Boxed {8}"), ("\\boxed{1} \\boxed{2", "boxed{1}")])
def test_raw_span_of_a_box_is_cut_from_the_text(spark, text, span):
    df = with_extracted(spark.createDataFrame([(text, "math")], "text string, task string"), "text", "task")
    assert df.select("extracted.raw_span").first()[0] == span


def closing(text, start):
    depth = 1
    for at in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[at], 0)
        if not depth:
            return at
    return None


def plain_box(text):
    """The last opener, of the form in braces if one closes, whose brace closes."""
    for pattern in (r"\{\\boxed\s*\{", r"(?i)boxed\s*\{"):
        for opener in reversed(list(re.finditer(pattern, text))):
            end = closing(text, opener.end())
            if end is not None:
                return text[opener.end() : end]
    return None


def test_boxes_against_a_plain_scan(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["\\boxed{", "{\\boxed{", "{", "}", "}", "x", "Boxed {"], k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", extraction.extract_boxed(F.col("t"))).collect())
    assert [got[i] for i in range(len(texts))] == [plain_box(t) for t in texts]


def test_unclosed_boxes_take_time_in_proportion(spark):
    def seconds(count):
        texts = ["\\boxed{" * count, "\\boxed{" + "{" * count, "\\boxed{a" * count + "}"]
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
        began = time.perf_counter()
        got = [r[0] for r in df.select(extraction.extract_boxed(F.col("t"))).collect()]
        assert got == [None, None, "a"]
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 30 + 10 * seconds(10_000)  # ten times the square would be a hundred
