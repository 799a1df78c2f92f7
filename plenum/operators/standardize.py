"""Benchmark rows of different shapes to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.extraction import balanced_braces
from plenum.functions.text import let, letters_for, split_at, strip

# ---------------------------------------------------------------------------
# Fixed values (category names, markers and labels of the benchmark files)
BBH_MULTIPLE_CHOICE = (
    "temporal_sequences",
    "logical_deduction_three_objects",
    "date_understanding",
    "hyperbaton",
    "penguins_in_a_table",
    "reasoning_about_colored_objects",
    "snarks",
    "tracking_shuffled_objects_seven_objects",
    "movie_recommendation",
    "logical_deduction_five_objects",
    "logical_deduction_seven_objects",
    "geometric_shapes",
    "disambiguation_qa",
    "tracking_shuffled_objects_five_objects",
    "ruin_names",
    "tracking_shuffled_objects_three_objects",
    "salient_translation_error_detection",
)
BBH_YES_NO = (
    "navigate",
    "causal_judgement",
    "boolean_expressions",
    "sports_understanding",
    "web_of_lies",
)
BBH_CATEGORIES = BBH_MULTIPLE_CHOICE + BBH_YES_NO
BBH_TEST_ROWS = 1260
BBH_VALIDATION_ROWS = 500
OPTIONS_MARKER = "\nOptions:\n"
OPTION_LABEL = r"(?mdU)^\(([A-R])\)\s*"
UNSCORABLE = "__UNSCORABLE__"
FEW_OPTIONS = "fewer_than_two_options"
BOOLEAN_QUESTION = "Is the following boolean expression True? "
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
# ---------------------------------------------------------------------------

NO_TEXTS = "cast(array() as array<string>)"


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _text(df: DataFrame, *names: str) -> Column:
    """First column that exists, as text; '' when none does or it is NULL."""
    for name in names:
        if _has(df, name):
            value = F.col(name)
            if isinstance(df.schema[name].dataType, T.BooleanType):
                value = F.when(value, "True").when(~value, "False")
            return F.coalesce(value.cast("string"), F.lit(""))
    return F.lit("")


def common_columns(df: DataFrame, task_type: str) -> DataFrame:
    """Add the unified columns with their defaults; raw columns stay."""
    raw_answer = _text(df, "answer", "answerKey")
    index = F.col("source_index") if _has(df, "source_index") else F.lit(None)
    out = df.withColumn("raw_answer", raw_answer)
    for name in ("dataset", "source_split", "subject", "category"):
        out = out.withColumn(name, _text(df, name))
    return out.withColumn("source_index", index.cast("bigint")).withColumn("task_type", F.lit(task_type))


UNIFIED = (
    "dataset", "source_split", "source_index", "subject", "category", "question",
    "passage", "answer", "raw_answer", "choices", "task_type",
)


def unknown_task(df: DataFrame, task_type: str) -> DataFrame:
    """Defaults only, for a task type without a rule."""
    return (
        common_columns(df, task_type)
        .withColumn("question", F.lit(""))
        .withColumn("passage", F.lit(""))
        .withColumn("answer", F.lit(""))
        .withColumn("choices", F.expr(NO_TEXTS))
        .select(*UNIFIED)
    )


def yes_no(df: DataFrame) -> DataFrame:
    """True or "true" is yes, everything else no."""
    truth = F.coalesce(F.lower(_text(df, "answer")) == "true", F.lit(False))
    return (
        common_columns(df, "yes_no")
        .withColumn("question", _text(df, "question"))
        .withColumn("passage", _text(df, "passage"))
        .withColumn("answer", F.when(truth, "yes").otherwise("no"))
        .withColumn("choices", F.array(F.lit("Yes"), F.lit("No")))
        .select(*UNIFIED)
    )


def key_to_letter(
    answer: Column, choices: Column, labels: Column, source_labels: Column | None = None
) -> Column:
    """Label or choice text to the canonical letter.

    Tried in this order: a label of the source, a canonical label, the text of
    a choice; anything else stays as it is.
    """
    cleaned = F.btrim(strip(F.upper(answer)), F.lit("()"))

    def resolve(key: Column) -> Column:
        at_text = F.array_position(F.transform(choices, lambda c: strip(F.upper(c))), key)
        by_text = F.when(at_text > 0, F.get(labels, (at_text - 1).cast("int"))).otherwise(key)
        canonical = F.when(F.array_contains(labels, key), key).otherwise(by_text)
        if source_labels is None:
            return canonical
        at_label = F.array_position(source_labels, key)
        return F.when(at_label > 0, F.get(labels, (at_label - 1).cast("int"))).otherwise(canonical)

    return let(cleaned, resolve)


def index_to_letter(index: Column, choices: Column) -> Column:
    """0 -> A ...; '' when the index lies beyond the choices (4 without any)."""
    size = F.when(F.size(choices) > 0, F.size(choices)).otherwise(4)
    return F.when(index < size, F.char((index + 65).cast("int"))).otherwise("")


def _multiple_choice(df: DataFrame, choices: Column, source_labels: Column | None) -> DataFrame:
    key = "answer" if _has(df, "answer") else "answerKey"
    numeric = isinstance(df.schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType))
    out = (
        common_columns(df, "multiple_choice")
        .withColumn("question", _text(df, "question"))
        .withColumn("passage", _text(df, "passage"))
        .withColumn("__choices", choices)
        .withColumn("choice_labels", letters_for(F.col("__choices")))
    )
    extra = ["choice_labels"]
    if source_labels is not None:
        cleaned = F.transform(source_labels, lambda x: strip(F.upper(x)))
        out = out.withColumn("source_choice_labels", cleaned)
        extra.append("source_choice_labels")
    given = F.col(key)
    answer = (
        index_to_letter(given, F.col("__choices"))
        if numeric
        else key_to_letter(
            F.coalesce(given, F.lit("")), F.col("__choices"), F.col("choice_labels"),
            F.col("source_choice_labels") if source_labels is not None else None,
        )
    )
    return (
        out.withColumn("answer", answer).drop("choices").withColumnRenamed("__choices", "choices")
        .select(*UNIFIED, *extra)
    )


def choice_list(df: DataFrame) -> DataFrame:
    """Choices as a list; labels by position."""
    return _multiple_choice(df, F.coalesce(F.col("choices"), F.expr(NO_TEXTS)), None)


def choice_struct(df: DataFrame) -> DataFrame:
    """Choices as {text, label}: source labels are kept beside the canonical ones."""
    return _multiple_choice(df, F.col("choices.text"), F.col("choices.label"))


def choice_distractors(df: DataFrame) -> DataFrame:
    """Correct answer and distractors in an order fixed by their content."""
    wrong = F.filter(
        F.array("distractor1", "distractor2", "distractor3"), lambda x: F.length(x) > 0
    )
    out = (
        common_columns(df, "multiple_choice")
        .withColumn("question", _text(df, "question"))
        .withColumn("passage", _text(df, "passage"))
        .withColumn("__wrong", wrong)
        .withColumn("__seed", F.md5(F.concat("correct_answer", F.array_join("__wrong", ""))))
    )
    options = F.concat(F.array("correct_answer"), F.col("__wrong"))
    keyed = F.transform(
        options, lambda o: F.struct(F.sha2(F.concat(F.col("__seed"), o), 256).alias("k"), o.alias("o"))
    )
    ordered = F.transform(F.array_sort(keyed), lambda x: x["o"])
    usable = (F.length("correct_answer") > 0) & (F.size("__wrong") > 0)
    place = F.array_position(F.col("choices"), F.col("correct_answer"))
    return (
        out.withColumn("choices", F.when(usable, ordered).otherwise(F.expr(NO_TEXTS)))
        .withColumn("choice_labels", letters_for(F.col("choices")))
        .withColumn("answer", F.when(place > 0, F.char((place + 64).cast("int"))).otherwise(""))
        .select(*UNIFIED, "choice_labels")
    )


def math_answer(raw: Column) -> Column:
    """The first box, else the number behind the last ####, else the last number."""
    opener = "\\boxed{"
    start = F.instr(raw, opener)
    boxed = let(
        F.substr(raw, start + len(opener)),
        lambda rest: let(
            strip(F.coalesce(balanced_braces(rest), F.lit(""))),
            lambda c: F.when(F.length(c) > 0, c).otherwise(strip(raw)),
        ),
    )
    after = strip(F.substring_index(raw, "####", -1))
    behind = let(
        F.regexp_extract(after, NUMBER, 0), lambda n: F.when(F.length(n) > 0, n).otherwise(after)
    )
    numbers = F.regexp_extract_all(raw, F.lit(NUMBER), F.lit(0))
    last = F.coalesce(F.try_element_at(numbers, F.lit(-1)), strip(raw))
    return F.when(start > 0, boxed).when(F.instr(raw, "####") > 0, behind).otherwise(last)


def maths(df: DataFrame) -> DataFrame:
    return (
        common_columns(df, "math")
        .withColumn("question", _text(df, "question", "problem"))
        .withColumn("passage", F.lit(""))
        .withColumn("answer", math_answer(_text(df, "answer", "solution")))
        .withColumn("choices", F.expr(NO_TEXTS))
        .select(*UNIFIED)
    )


def mixed(df: DataFrame) -> DataFrame:
    """Free text, yes/no or choices; labels given by the source are kept."""
    key = "answer" if _has(df, "answer") else "target"
    boolean = isinstance(df.schema[key].dataType, T.BooleanType)
    labels: Column = F.expr(NO_TEXTS)
    choices: Column = F.expr(NO_TEXTS)
    if _has(df, "choices"):
        if isinstance(df.schema["choices"].dataType, T.StructType):
            choices = F.col("choices.text")
            labels = F.coalesce(F.col("choices.label"), letters_for(choices))
        else:
            choices = F.coalesce(F.col("choices"), F.expr(NO_TEXTS))
            labels = letters_for(choices)
    if boolean:
        answer = F.when(F.col(key), "yes").otherwise("no")
        choices = F.array(F.lit("Yes"), F.lit("No"))
    else:
        answer = strip(_text(df, key))
    return (
        common_columns(df, "mixed")
        .withColumn("question", _text(df, "question", "input"))
        .withColumn("passage", F.lit(""))
        .withColumn("answer", answer)
        .withColumn("choice_labels", labels)
        .withColumn("__choices", choices)
        .drop("choices")
        .withColumnRenamed("__choices", "choices")
        .select(*UNIFIED, "choice_labels")
    )


def bbh_options(text: Column) -> Column:
    """struct(question, choices, labels) from the text behind the last marker."""
    block = F.substring_index(text, OPTIONS_MARKER, -1)
    question = F.substr(
        text, F.lit(1), F.length(text) - F.length(block) - len(OPTIONS_MARKER)
    )
    labels = F.regexp_extract_all(block, F.lit(OPTION_LABEL), F.lit(1))
    parts = split_at(block, OPTION_LABEL)
    choices = F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip)
    complete = (F.instr(text, OPTIONS_MARKER) > 0) & (F.size(labels) > 0)
    return F.when(
        complete,
        F.struct(
            strip(question).alias("question"), choices.alias("choices"), labels.alias("labels")
        ),
    ).otherwise(F.raise_error(F.lit("multiple-choice input without options")))


def bbh_standardize(df: DataFrame, category: str = "subject") -> DataFrame:
    """Category rules; unscorable rows stay, so they count in denominators.

    Reads ``input`` and ``target``; keeps the raw target and source index.
    """
    name = F.regexp_replace(F.col(category), r"\.json$", "")
    target = strip(F.coalesce(F.col("target"), F.lit("")))
    base = (
        df.withColumn("subject", name)
        .withColumn("dataset", F.lit("bbh"))
        .withColumn("bbh_raw_target", target)
        .withColumn("bbh_source_index", F.col("source_index").cast("bigint"))
        .withColumn(
            "__kind",
            F.when(F.col("subject").isin(*BBH_MULTIPLE_CHOICE), "multiple_choice")
            .when(F.col("subject").isin(*BBH_YES_NO), "yes_no")
            .otherwise("mixed"),
        )
    )
    kind, text = F.col("__kind"), F.col("input")
    base = base.withColumn("__options", F.when(kind == "multiple_choice", bbh_options(text)))
    letter = F.regexp_extract(F.upper(F.col("bbh_raw_target")), r"^\(([A-R])\)$", 1)
    mc_answer = let(letter, lambda x: F.when(F.length(x) > 0, x).otherwise(UNSCORABLE))
    lowered = F.lower(F.col("bbh_raw_target"))
    yn_answer = (
        F.when(lowered.isin("yes", "true"), "yes")
        .when(lowered.isin("no", "false"), "no")
        .otherwise(F.raise_error(F.concat(F.lit("unexpected yes/no target: "), lowered)))
    )
    expression = F.when(text.endswith(" is"), F.substr(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    yn_question = (
        F.when(
            (F.col("subject") == "web_of_lies") & text.startswith("Question: "),
            F.substr(text, F.lit(len("Question: ") + 1)),
        )
        .when(F.col("subject") == "boolean_expressions", F.concat(F.lit(BOOLEAN_QUESTION), expression))
        .otherwise(text)
    )
    options = F.col("__options")
    positional = letters_for(options["choices"])
    choices = (
        F.when(kind == "multiple_choice", options["choices"])
        .when(kind == "yes_no", F.array(F.lit("Yes"), F.lit("No")))
        .otherwise(F.expr(NO_TEXTS))
    )
    relabelled = let(
        mc_answer,
        lambda a: F.when(a == UNSCORABLE, a).otherwise(
            key_to_letter(a, options["choices"], positional, options["labels"])
        ),
    )
    return base.select(
        "dataset", "source_split", "source_index", "subject",
        F.when(kind == "multiple_choice", options["question"])
        .when(kind == "yes_no", yn_question)
        .otherwise(text)
        .alias("question"),
        F.lit("").alias("passage"),
        F.when(kind == "multiple_choice", relabelled)
        .when(kind == "yes_no", yn_answer)
        .otherwise(F.col("bbh_raw_target"))
        .alias("answer"),
        choices.alias("choices"),
        F.when(kind == "multiple_choice", positional).alias("choice_labels"),
        kind.alias("task_type"),
        "bbh_raw_target",
        "bbh_source_index",
        F.when((kind == "multiple_choice") & (F.size(options["choices"]) < 2), FEW_OPTIONS).alias(
            "bbh_source_warning"
        ),
    )


STANDARDIZERS = {
    "boolq": yes_no,
    "mmlu": choice_list,
    "sciq": choice_distractors,
    "arc": choice_struct,
    "math": maths,
    "gsm8k": maths,
    "bbh": bbh_standardize,
}
