from pyspark.sql import functions as F

from plenum.operators import prompts, standardize
from plenum.operators.sampling import split_stratified


def test_numeric_source_labels(spark):
    df = spark.createDataFrame(
        [("q", (["a", "b", "c", "d"], ["1", "2", "3", "4"]), "3")],
        "question string, choices struct<text:array<string>,label:array<string>>, answerKey string",
    )
    row = standardize.choice_struct(df).first()
    assert (row.answer, row.choice_labels, row.source_choice_labels) == ("C", list("ABCD"), list("1234"))


def test_index_answer(spark):
    df = spark.createDataFrame([("q", ["x", "y"], 1), ("q", ["x", "y"], 2), ("q", [], 3)], "question string, choices array<string>, answer int")
    assert sorted(r.answer for r in standardize.choice_list(df).collect()) == ["", "B", "D"]


def test_bbh_exact_split_sizes(spark):
    names = spark.createDataFrame([(n,) for n in standardize.BBH_CATEGORIES], "subject string")
    data = names.withColumn("source_index", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn(
        "key", F.concat("subject", F.lit("-"), F.col("source_index").cast("string"))
    ).drop("source_index")
    out = split_stratified(data, "key", 42, "subject", standardize.BBH_TEST_ROWS, standardize.BBH_VALIDATION_ROWS, exact=True)
    sizes = {r.source_split: r["count"] for r in out.groupBy("source_split").count().collect()}
    assert sizes == {"test": 1260, "validation": 500, "train": 440}


def test_bbh_bad_rows_stay(spark):
    data = [
        ("snarks", "Q\nOptions:\n(A) one", "Monsters, Inc", 3), ("navigate", "Go?", "Yes", 4),
        ("boolean_expressions", "not True is", "False", 5), ("other", "free", "x y", 6),
    ]
    df = spark.createDataFrame(data, "subject string, input string, target string, source_index int").withColumn("source_split", F.lit("test"))
    out = {r.subject: r for r in standardize.bbh_standardize(df).collect()}
    assert out["snarks"].answer == standardize.UNSCORABLE
    assert out["snarks"].bbh_source_warning == "fewer_than_two_options"
    assert (out["navigate"].answer, out["boolean_expressions"].answer) == ("yes", "no")
    assert out["boolean_expressions"].question.endswith("True? not True")
    assert out["other"].task_type == "mixed"


def test_templates_do_not_expand_values(spark):
    df = spark.createDataFrame([("{passage}", "P", "yes_no", "boolq", [], None, "", "", "")],
        "question string, passage string, task_type string, dataset string, choices array<string>, choice_labels array<string>, "
        "role_name string, actor_instruction string, critic_instruction string")
    text = df.select(prompts.actor_prompt()).first()[0]
    assert "Question: {passage}?" in text and text.endswith("Passage: P")


def test_trim_middle(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(10)),)], "t string")
    cut = lambda n: df.select(prompts.trim_middle(F.col("t"), F.lit(n))).first()[0]
    assert cut(10) == " ".join(f"w{i}" for i in range(10))
    assert cut(7) == "w0 w1\n...[truncated 3 tokens]...\nw8 w9"
    assert (cut(3), cut(0)) == ("w7 w8 w9", "")
