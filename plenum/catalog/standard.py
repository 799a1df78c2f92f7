"""Standardization of raw question rows built from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.operators import standardize



def part(spark, d):
    return inputs.table(spark, d, "part").withColumn("m", F.col("p_partkey") % 5)


def flat(df, *columns):
    return df.select(
        F.col("source_index").alias("p_partkey"), *columns,
        F.array_join("choices", "|").alias("choices"),
    )


def base(spark, d):
    return part(spark, d).select(
        "*", F.col("p_partkey").alias("source_index"), F.lit("train").alias("source_split"), F.col("p_name").alias("question"),
    )


def options(*names):
    return F.array(*[F.col(n).cast("string") if isinstance(n, str) else n for n in names])


@query(
    "std_common_columns",
    """SELECT p_partkey, '' AS dataset, 'train' AS source_split, p_type AS subject, '' AS category, '' AS question, '' AS answer,
              coalesce(CAST(nullif(p_size, 7) AS VARCHAR), '') AS raw_answer, '' AS choices, 'other' AS task_type FROM part""",
)
def std_common(spark, d):
    rows = base(spark, d).select(
        "source_index", "source_split", F.col("p_type").alias("subject"), F.nullif(F.col("p_size"), F.lit(7)).alias("answerKey")
    )
    return flat(standardize.unknown_task(rows, "other"), "dataset", "source_split", "subject", "category", "question", "answer", "raw_answer", "task_type")


@query(
    "std_yes_no",
    """SELECT p_partkey, p_name AS question, p_type AS passage, CASE WHEN m IN (0, 1) THEN 'yes' ELSE 'no' END AS answer,
              CASE m WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'junk' ELSE '' END AS raw_answer, 'Yes|No' AS choices
       FROM (SELECT *, p_partkey % 5 AS m FROM part)""",
)
def std_yes_no(spark, d):
    m = F.col("m")
    answer = F.when(m == 0, "TRUE").when(m == 1, "true").when(m == 2, "false").when(m == 3, "junk")
    rows = base(spark, d).select("source_index", "source_split", "question", F.col("p_type").alias("passage"), answer.alias("answer"))
    return flat(standardize.yes_no(rows), "question", "passage", "answer", "raw_answer")


@query(
    "std_mc_list",
    """SELECT p_partkey, CASE WHEN m = 4 THEN CASE WHEN p_size % 6 < 4 THEN chr(CAST(65 + p_size % 6 AS INT)) ELSE '' END
                             WHEN p_size % 6 <= 3 THEN chr(CAST(65 + p_size % 6 AS INT)) ELSE '' END AS answer,
              CASE WHEN m = 4 THEN '' ELSE 'A,B,C,D' END AS labels,
              CASE WHEN m = 4 THEN '' ELSE p_brand || '|' || p_type || '|' || p_size || '|none' END AS choices
       FROM (SELECT *, p_partkey % 5 AS m FROM part)""",
)
def std_mc_list(spark, d):
    rows = base(spark, d).select(
        "source_index", "source_split", "question",
        F.when(F.col("m") != 4, options("p_brand", "p_type", "p_size", F.lit("none"))).alias("choices"),
        (F.col("p_size") % 6).alias("answer"),
    )
    return flat(standardize.choice_list(rows), "answer", F.array_join("choice_labels", ",").alias("labels"))


@query(
    "std_mc_struct_labels",
    """SELECT p_partkey, chr(CAST(65 + p_size % 4 AS INT)) AS answer, 'A,B,C,D' AS labels, '1,2,3,4' AS source_labels,
              p_brand || '|' || p_type || '|x|y' AS choices FROM part""",
)
def std_mc_struct(spark, d):
    rows = base(spark, d).select(
        "source_index", "source_split", "question",
        F.struct(options("p_brand", "p_type", F.lit("x"), F.lit("y")).alias("text"),
                 F.array(*[F.lit(x) for x in ("1", " 2", "3 ", "4")]).alias("label")).alias("choices"),
        (F.col("p_size") % 4 + 1).cast("string").alias("answerKey"),
    )
    return flat(
        standardize.choice_struct(rows), "answer", F.array_join("choice_labels", ",").alias("labels"),
        F.array_join("source_choice_labels", ",").alias("source_labels"),
    )


@query(
    "std_mc_distractors",
    """SELECT p_partkey, array_to_string(choices, '|') AS choices, chr(CAST(64 + list_position(choices, p_name) AS INT)) AS answer, len(choices)::INT AS n
       FROM (SELECT p_partkey, p_name, list_transform(list_sort(list_transform(opts, lambda o: {'k': sha256(md5(array_to_string(opts, '')) || o), 'o': o})), lambda x: x.o) AS choices
             FROM (SELECT p_partkey, p_name, list_filter([p_name, p_brand, CASE WHEN p_size % 3 > 0 THEN p_type ELSE '' END, 'size ' || p_size], lambda x: x <> '') AS opts FROM part))""",
)
def std_mc_distractors(spark, d):
    rows = base(spark, d).select(
        "source_index", "source_split", "question", F.col("p_name").alias("correct_answer"), F.col("p_brand").alias("distractor1"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise("").alias("distractor2"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("distractor3"),
    )
    return flat(standardize.choice_distractors(rows), "answer", F.size("choices").alias("n"))


@query(
    "std_mc_answer_key",
    """SELECT p_partkey, CASE m WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'A' ELSE 'ZZ' END AS answer
       FROM (SELECT *, p_partkey % 5 AS m FROM part)""",
)
def std_mc_answer_key(spark, d):
    m = F.col("m")
    # source labels C, A, B, D: "(a)" is the second choice, "B" the third,
    # a choice text its position, "c" the first, and junk stays
    answer = (
        F.when(m == 0, " (a) ").when(m == 1, "B").when(m == 2, F.concat(F.lit(" "), F.lower("p_brand"))).when(m == 3, "c").otherwise("zz")
    )
    rows = base(spark, d).select(
        "source_index", "source_split", "question", answer.alias("answer"),
        F.struct(options("p_brand", "p_type", F.lit("x"), F.lit("y")).alias("text"),
                 F.array(*[F.lit(x) for x in "CABD"]).alias("label")).alias("choices"),
    )
    return standardize.choice_struct(rows).select(F.col("source_index").alias("p_partkey"), "answer")


@query(
    "std_math_answer",
    r"""SELECT p_partkey, CASE m WHEN 0 THEN '\frac{' || p_size || '}{3}' WHEN 1 THEN '-' || p_size || '.5' WHEN 2 THEN CAST(p_size AS VARCHAR)
               WHEN 3 THEN '\boxed{' || p_size ELSE 'no number' END AS answer FROM (SELECT *, p_partkey % 5 AS m FROM part)""",
)
def std_math(spark, d):
    m, size = F.col("m"), F.col("p_size").cast("string")
    answer = (
        F.when(m == 0, F.concat(F.lit("So \\boxed{ \\frac{"), size, F.lit("}{3} } or \\boxed{7}")))
        .when(m == 1, F.concat(F.lit("1 + 2 #### 3 #### about -"), size, F.lit(".5 kg 9")))
        .when(m == 2, F.concat(F.lit("12 then "), size, F.lit(" end")))
        .when(m == 3, F.concat(F.lit(" \\boxed{"), size, F.lit(" ")))
        .otherwise(" no number ")
    )
    rows = base(spark, d).select("source_index", "source_split", F.col("question").alias("problem"), answer.alias("solution"))
    return standardize.maths(rows).select(F.col("source_index").alias("p_partkey"), "answer")


@query(
    "std_mixed",
    """SELECT p_partkey, p_name AS question, p_type AS answer, p_brand || '|other' AS choices, 'i,ii' AS labels FROM part
       UNION ALL SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END, 'Yes|No', '' FROM part""",
)
def std_mixed(spark, d):
    rows = base(spark, d)
    listed = rows.select(
        "source_index", F.col("question").alias("input"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("target"),
        F.struct(options("p_brand", F.lit("other")).alias("text"), F.array(F.lit("i"), F.lit("ii")).alias("label")).alias("choices"),
    )
    truth = rows.select("source_index", "question", (F.col("p_size") % 2 == 0).alias("answer"))
    both = standardize.mixed(listed).unionByName(standardize.mixed(truth))
    return flat(both, "question", "answer", F.array_join("choice_labels", ",").alias("labels"))


def bbh_rows(spark, d):
    """Rows of all 22 categories: the part key picks the category."""
    names = F.array(*[F.lit(n) for n in standardize.BBH_CATEGORIES])
    key, size = F.col("p_partkey"), F.col("p_size")
    letter = F.char((size % 3 + 65).cast("int"))
    subject = F.element_at(names, (key % 22 + 1).cast("int"))
    choice = key % 22 < 17
    text = (
        F.when(choice, F.concat("p_name", F.lit("\nOptions:\nfake\nOptions:\n(A) "), "p_brand", F.lit("\n(B) "), "p_type",
                                F.when(size % 2 == 0, "\n(C)  third\n ").otherwise("")))
        .when(subject == "web_of_lies", F.concat(F.lit("Question: "), "p_name"))
        .when(subject == "boolean_expressions", F.concat("p_name", F.lit(" is")))
        .otherwise(F.col("p_name"))
    )
    target = (
        F.when(choice, F.when(size % 11 == 0, "Monsters, Inc").otherwise(F.concat(F.lit("("), letter, F.lit(") "))))
        .otherwise(F.element_at(F.array(*[F.lit(x) for x in ("yes", "True", "No", "false")]), (size % 4 + 1).cast("int")))
    )
    return inputs.table(spark, d, "part").select(
        F.concat(subject, F.lit(".json")).alias("subject"), text.alias("input"), target.alias("target"),
        key.alias("source_index"), F.lit("test").alias("source_split"),
    )


BBH_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in standardize.BBH_CATEGORIES) + "]"
BBH_SQL = f"""
SELECT *, CASE WHEN c < 17 THEN p_brand || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN '|third' ELSE '' END ELSE 'Yes|No' END AS choices
FROM (SELECT *, p_partkey % 22 AS c, {BBH_NAMES_SQL}[1 + (p_partkey % 22)::INT] AS subject FROM part)"""


@query(
    "bbh_parse_options",
    f"""SELECT p_partkey, p_name || chr(10) || 'Options:' || chr(10) || 'fake' AS question, choices, CASE WHEN p_size % 2 = 0 THEN 'A,B,C' ELSE 'A,B' END AS labels
        FROM ({BBH_SQL}) WHERE c < 17""",
)
def bbh_parse(spark, d):
    rows = bbh_rows(spark, d).filter(F.instr("input", standardize.OPTIONS_MARKER) > 0)
    parsed = rows.withColumn("o", standardize.bbh_options(F.col("input")))
    return parsed.select(
        F.col("source_index").alias("p_partkey"), "o.question", F.array_join("o.choices", "|").alias("choices"), F.array_join("o.labels", ",").alias("labels")
    )


@query(
    "bbh_standardize",
    f"""SELECT p_partkey, subject, choices, CASE WHEN c < 17 THEN 'multiple_choice' ELSE 'yes_no' END AS task_type,
               CASE WHEN c < 17 THEN p_name || chr(10) || 'Options:' || chr(10) || 'fake' WHEN subject = 'boolean_expressions' THEN 'Is the following boolean expression True? ' || p_name ELSE p_name END AS question,
               CASE WHEN c < 17 THEN CASE WHEN p_size % 11 = 0 THEN '__UNSCORABLE__' ELSE chr(CAST(65 + p_size % 3 AS INT)) END
                    WHEN p_size % 4 < 2 THEN 'yes' ELSE 'no' END AS answer,
               CASE WHEN c < 17 THEN CASE WHEN p_size % 11 = 0 THEN 'Monsters, Inc' ELSE '(' || chr(CAST(65 + p_size % 3 AS INT)) || ')' END
                    ELSE ['yes', 'True', 'No', 'false'][1 + (p_size % 4)::INT] END AS bbh_raw_target, p_partkey AS bbh_source_index,
               NULL::VARCHAR AS bbh_source_warning
        FROM ({BBH_SQL})""",
)
def bbh_standardize(spark, d):
    return flat(
        standardize.bbh_standardize(bbh_rows(spark, d)), "subject", "task_type", "question", "answer",
        "bbh_raw_target", "bbh_source_index", "bbh_source_warning",
    )
