"""Input tables of the registered queries, derived from the given tables.

Each table has a Spark builder and a SQL text for the twin query.  All rows of
the source tables are used, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import let

ROLES = ("direct", "evidence", "verification")
CANDIDATES = ("natural", "guided_positive", "guided_negative")
ROLLOUTS = 10
TASK_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores (a small file).

    A large table already has more splits, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, by: str, rows: int | None = None) -> DataFrame:
    """Rows of a base table by the hash of a key, a bounded number in each partition.

    The grids that are made of a row by expanding it stay in its task: no task
    expands more than about ``rows`` (``TASK_ROWS``) of them, and what is grouped by
    the key needs no other shuffle.  Counting reads the Parquet footers only.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or TASK_ROWS)))
    return df.repartition(parts, by)


def _letter(position: Column) -> Column:
    return F.char((position + 65).cast("int"))


def _numbered(names, index: str, name: str) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(i).alias(index), F.lit(n).alias(name)) for i, n in enumerate(names)])
    )


def each(df: DataFrame, names, index: str, name: str) -> DataFrame:
    """One row per entry of a short fixed list."""
    return df.withColumn("__e", _numbered(names, index, name)).select(
        *df.columns, f"__e.{index}", f"__e.{name}"
    )


def each_int(df: DataFrame, values, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


SQL_INPUTS: dict[str, str] = {}

# --------------------------------------------------------------------- samples
SQL_INPUTS["samples"] = """
SELECT o_orderkey AS sample_index,
       'bench_test_' || printf('%08d', o_orderkey) AS sample_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'boolq' WHEN 1 THEN 'mmlu' WHEN 2 THEN 'bbh'
            WHEN 3 THEN 'sciq' ELSE 'arc' END AS dataset,
       CASE WHEN o_orderkey % 5 = 0 THEN 'yes_no' ELSE 'multiple_choice' END AS task_type,
       o_orderpriority AS subject, o_custkey AS custkey,
       CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END
            ELSE chr(CAST(65 + o_custkey % 4 AS INT)) END AS gold
FROM orders"""


def samples(spark: SparkSession, sf_dir: str, by: str = "sample_index", rows: int | None = None) -> DataFrame:
    """One row per order, dealt out by ``by``: sample_index or sample_id, some ``rows`` to a task."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return _dealt_orders(spark, sf_dir, by, rows).select(
        "sample_index",
        "sample_id",
        _dataset(key).alias("dataset"),
        _task_type(key).alias("task_type"),
        F.col("o_orderpriority").alias("subject"),
        cust.alias("custkey"),
        _gold(key, cust).alias("gold"),
    )


def _dealt_orders(spark: SparkSession, sf_dir: str, by: str, rows: int | None) -> DataFrame:
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("sample_index"), F.format_string("bench_test_%08d", key).alias("sample_id"), "o_orderkey", "o_custkey", "o_orderpriority"
    )
    return dealt(orders, by, rows)


def _dataset(key: Column) -> Column:
    names = ["boolq", "mmlu", "bbh", "sciq", "arc"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % 5 + 1).cast("int"))


def _task_type(key: Column) -> Column:
    return F.when(key % 5 == 0, "yes_no").otherwise("multiple_choice")


def _gold(key: Column, cust: Column) -> Column:
    return F.when(key % 5 == 0, F.when(cust % 2 == 0, "YES").otherwise("NO")).otherwise(_letter(cust % 4))


# ----------------------------------------------------------------- completions
SQL_INPUTS["completions"] = """
SELECT c.*, k % 13 = 0 AS truncated,
       CASE WHEN label IS NULL THEN 'I cannot decide.'
       WHEN k % 6 = 0 THEN 'The final result is ' || label || '.'
       WHEN k % 6 = 1 THEN 'Final Answer: ' || label
       WHEN k % 6 = 2 THEN 'The correct answer is ' || label || '.'
       WHEN k % 6 = 3 THEN 'I choose ' || label
       WHEN k % 6 = 4 THEN 'Answer: ' || label
       ELSE label END AS tail_text
FROM (SELECT b.*, CASE WHEN k = 10 THEN NULL WHEN k < 5 + round THEN gold
             WHEN task_type = 'yes_no' THEN CASE WHEN gold = 'YES' THEN 'NO' ELSE 'YES' END
             ELSE chr(CAST(65 + (custkey + 1 + k % 3) % 4 AS INT)) END AS label
      FROM (SELECT s.*, role, role_idx, round,
                   (sample_index * 31 + custkey * 17 + role_idx * (13 + sample_index % 7) + round * 7) % 11 AS k
            FROM samples s
            CROSS JOIN (VALUES (0, 'direct'), (1, 'evidence'), (2, 'verification')) AS r(role_idx, role)
            CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(round)) b) c"""


def completions(
    spark: SparkSession, sf_dir: str, names=ROLES, trials: int | None = None, rounds: int = 5, by: str = "sample_index"
) -> DataFrame:
    """One row per sample, role, round (and trial); a task has as many rows with trials as without."""
    dealt_out = samples(spark, sf_dir, by, TASK_ROWS // (trials or 1))
    grid = each_int(each(dealt_out, names, "role_idx", "role"), range(rounds), "round")
    if trials is not None:
        grid = each_int(grid, range(trials), "trial")
    shift = F.col("trial") * 3 if trials is not None else F.lit(0)
    return (
        grid.withColumn("k", _draw(F.col("round"), shift))
        .withColumn("truncated", F.col("k") % 13 == 0)
        .withColumn("label", _label(F.col("k"), F.col("round")))
        .withColumn("tail_text", _tail(F.col("k"), F.col("label")))
    )


def _draw(round_: Column, shift: Column, cust: Column | None = None) -> Column:
    index, role = F.col("sample_index"), F.col("role_idx")
    cust = F.col("custkey") if cust is None else cust
    return (index * 31 + cust * 17 + role * (index % 7 + 13) + round_ * 7 + shift) % 11


def _label(k: Column, round_: Column, cust: Column | None = None, gold: Column | None = None) -> Column:
    cust, gold = F.col("custkey") if cust is None else cust, F.col("gold") if gold is None else gold
    wrong = F.when(F.col("task_type") == "yes_no", F.when(gold == "YES", "NO").otherwise("YES")).otherwise(
        _letter((cust + 1 + k % 3) % 4)
    )
    return F.when(k == 10, None).when(k < round_ + 5, gold).otherwise(wrong)


def _tail(k: Column, label: Column) -> Column:
    return (
        F.when(label.isNull(), "I cannot decide.")
        .when(k % 6 == 0, F.concat(F.lit("The final result is "), label, F.lit(".")))
        .when(k % 6 == 1, F.concat(F.lit("Final Answer: "), label))
        .when(k % 6 == 2, F.concat(F.lit("The correct answer is "), label, F.lit(".")))
        .when(k % 6 == 3, F.concat(F.lit("I choose "), label))
        .when(k % 6 == 4, F.concat(F.lit("Answer: "), label))
        .otherwise(label)
    )


# five trials of all rounds
SQL_INPUTS["trial_completions"] = (
    SQL_INPUTS["completions"]
    .replace("round * 7) % 11 AS k", "round * 7 + trial * 3) % 11 AS k, trial")
    .replace("AS t(round)) b) c", "AS t(round) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS z(trial)) b) c")
)

AGENTS = ("agent0", "agent1", "agent2", "agent3")
# the same rule for four equal agents
SQL_INPUTS["agent_completions"] = SQL_INPUTS["completions"].replace(
    "(0, 'direct'), (1, 'evidence'), (2, 'verification')",
    "(0, 'agent0'), (1, 'agent1'), (2, 'agent2'), (3, 'agent3')",
)


def votes(
    spark: SparkSession, sf_dir: str, names=ROLES, trials: int | None = None, by: str = "sample_index"
) -> DataFrame:
    """Completions as answered rows: answer, parsed, correct, truncated."""
    return completions(spark, sf_dir, names, trials, by=by).select(
        F.lit("full").alias("variant"), *(["trial"] if trials is not None else []),
        "dataset", "sample_index", "sample_id", "task_type", "subject", "gold",
        "round", "role", "role_idx", "truncated",
        F.col("label").alias("answer"),
        F.col("label").isNotNull().alias("parsed"),
        F.coalesce(F.col("label") == F.col("gold"), F.lit(False)).alias("correct"),
    )


SQL_INPUTS["votes"] = """
SELECT 'full' AS variant, dataset, sample_index, sample_id, task_type, subject, gold,
       round, role, role_idx, truncated, label AS answer, label IS NOT NULL AS parsed,
       coalesce(label = gold, false) AS correct
FROM completions"""

SQL_INPUTS["agent_votes"] = SQL_INPUTS["votes"].replace("FROM completions", "FROM agent_completions")


def records(
    spark: SparkSession, sf_dir: str, trials: int | None = None, by: str = "sample_index", rounds: int = 5
) -> DataFrame:
    """Nested records: one row per (trial,) sample and role with its rounds, five or the first of them.

    The orders of a key are grouped before they are expanded: the rounds of a key with
    one customer are columns of its row, and nothing is grouped or sorted by record.
    Of orders with the same key the greatest turn counts.
    """
    dealt_out = _dealt_orders(spark, sf_dir, by, TASK_ROWS // (trials or 1))
    grouped = dealt_out.groupBy("sample_index", "sample_id").agg(F.collect_set(F.struct("o_custkey")).alias("__custs"))
    index, first, several = F.col("sample_index"), F.get("__custs", F.lit(0))["o_custkey"], F.size("__custs") > 1
    keyed = grouped.select(
        "sample_index", "sample_id", _dataset(index).alias("dataset"), _task_type(index).alias("task_type"),
        first.alias("custkey"), _gold(index, first).alias("gold"), F.when(several, F.col("__custs")).alias("__custs"),
    )
    grid = each(keyed, ROLES, "role_idx", "role")
    if trials is not None:
        grid = each_int(grid, range(trials), "trial")
    shift = F.col("trial") * 3 if trials is not None else F.lit(0)

    def turn(k: Column, label: Column, gold: Column) -> Column:
        hit = F.coalesce(label == gold, F.lit(False))
        return F.struct(_tail(k, label).alias("text"), label.alias("answer"), hit.alias("correct"), (k % 13 == 0).alias("truncated"))

    def of_customer(c: Column, r: Column) -> Column:
        cust = c["o_custkey"]
        return let(_gold(index, cust), lambda gold: let(
            _draw(r, shift, cust), lambda k: let(_label(k, r, cust, gold), lambda label: turn(k, label, gold))))

    single = F.col("__custs").isNull()

    # column by column for all rounds: code that does it round by round is too long a method to be compiled
    grid = grid.withColumns({f"__k{r}": _draw(F.lit(r), shift) for r in range(rounds)})
    grid = grid.withColumns({f"__label{r}": _label(F.col(f"__k{r}"), F.lit(r)) for r in range(rounds)})
    greatest = [F.array_max(F.transform("__custs", lambda c: of_customer(c, F.lit(r)))) for r in range(rounds)]
    grid = grid.withColumns({f"__greatest{r}": F.when(~single, found) for r, found in enumerate(greatest)})

    def nested(r: int) -> Column:
        k, label, best = (F.col(f"__{c}{r}") for c in ("k", "label", "greatest"))

        def of(own: Column, name: str) -> Column:
            return F.when(single, own).otherwise(best[name])

        # field by field, so that a reader of some makes no other
        text, answer = of(_tail(k, label), "text"), of(label, "answer")
        correct, truncated = of(F.coalesce(label == F.col("gold"), F.lit(False)), "correct"), of(k % 13 == 0, "truncated")
        completion = F.struct(
            text.alias("raw_response"), text.alias("response"), answer.alias("answer"),
            answer.isNotNull().alias("parsed"), correct.alias("correct"), truncated.alias("truncated"),
        )
        return F.struct(F.lit(r).alias("round"), F.struct(completion.alias("completion")).alias("actor"))

    named = ["dataset", "sample_index", "sample_id", "role", "role_idx", *(["trial"] if trials is not None else [])]
    golds = F.transform("__custs", lambda c: _gold(index, c["o_custkey"]))
    gold = F.when(single, F.col("gold")).otherwise(F.array_max(golds)).alias("gold")
    return grid.select(*named, "task_type", gold, F.array(*[nested(r) for r in range(rounds)]).alias("rounds"))


SQL_INPUTS["ballots"] = """
SELECT dataset, sample_index, sample_id, task_type, gold, round, d, e, v, d_cut, e_cut, v_cut,
       CASE WHEN d IS NOT NULL AND (d = e OR d = v) THEN d WHEN e IS NOT NULL AND e = v THEN e ELSE d END AS final,
       coalesce(d = e, false) OR coalesce(d = v, false) OR coalesce(e = v, false) AS majority,
       coalesce(d = e AND e = v, false) AS unanimous
FROM (SELECT dataset, sample_index, sample_id, task_type, gold, round,
             max(CASE WHEN role = 'direct' THEN label END) AS d,
             max(CASE WHEN role = 'evidence' THEN label END) AS e,
             max(CASE WHEN role = 'verification' THEN label END) AS v,
             bool_or(role = 'direct' AND truncated) AS d_cut, bool_or(role = 'evidence' AND truncated) AS e_cut,
             bool_or(role = 'verification' AND truncated) AS v_cut
      FROM completions GROUP BY ALL)"""

SQL_INPUTS["trial_votes"] = SQL_INPUTS["votes"].replace("'full' AS variant", "'full' AS variant, trial").replace(
    "FROM completions", "FROM trial_completions"
)
SQL_INPUTS["trial_ballots"] = (
    SQL_INPUTS["ballots"].replace("FROM completions", "FROM trial_completions").replace("gold, round,", "gold, trial, round,")
)

# -------------------------------------------------------------------- rollouts
SQL_INPUTS["rollouts"] = """
SELECT sample_id, sample_index, round, cand_idx, candidate, rollout,
       (sample_index * (rollout + 1) + custkey * 3 + round * 7 + cand_idx * rollout) % 10
                 < CASE candidate WHEN 'natural' THEN 1 + custkey % 8 WHEN 'guided_positive' THEN 9
                        ELSE 1 + sample_index % 4 END AS correct
FROM samples
CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(round)
CROSS JOIN (VALUES (0, 'natural'), (1, 'guided_positive'), (2, 'guided_negative')) AS c(cand_idx, candidate)
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS o(rollout)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = each_int(samples(spark, sf_dir, by="sample_id"), range(1, 5), "round")
    grid = each_int(each(grid, CANDIDATES, "cand_idx", "candidate"), range(ROLLOUTS), "rollout")
    index, cust, roll = F.col("sample_index"), F.col("custkey"), F.col("rollout")
    level = (
        F.when(F.col("candidate") == "natural", cust % 8 + 1)
        .when(F.col("candidate") == "guided_positive", 9)
        .otherwise(index % 4 + 1)
    )
    score = (index * (roll + 1) + cust * 3 + F.col("round") * 7 + F.col("cand_idx") * roll) % 10
    return grid.select(
        "sample_id", "sample_index", "round", "cand_idx", "candidate", "rollout",
        (score < level).alias("correct"),
    )


# Reward per candidate, and the three rewards of a (sample, round) side by side.
SQL_INPUTS["rewards"] = """
SELECT sample_id, sample_index, round, cand_idx, candidate,
       CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct_count, count(*) AS rollout_count,
       count(*) FILTER (WHERE correct) / count(*) AS reward
FROM rollouts GROUP BY ALL"""
SQL_INPUTS["reward_rows"] = """
SELECT sample_id, sample_index, round,
       max(CASE WHEN candidate = 'natural' THEN reward END) AS natural,
       max(CASE WHEN candidate = 'guided_positive' THEN reward END) AS guided_positive,
       max(CASE WHEN candidate = 'guided_negative' THEN reward END) AS guided_negative
FROM rewards GROUP BY ALL"""

# ------------------------------------------------------- preference candidates
# Text of each candidate: some are blank, some are equal up to blanks.
SQL_INPUTS["candidates"] = """
SELECT sample_id, sample_index, round, cand_idx, candidate,
       'Prompt of ' || sample_id || ' round ' || round || ' for ' || candidate AS prompt,
       CASE WHEN (sample_index + round * 3 + cand_idx) % 29 = 0 THEN '  '
            WHEN (sample_index + round) % 17 = 0 THEN 'Same feedback. '
            ELSE 'Feedback ' || candidate || ' on ' || custkey || '/' || round END AS response,
       (sample_index + round + cand_idx) % 31 = 0 AS truncated
FROM samples
CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(round)
CROSS JOIN (VALUES (0, 'natural'), (1, 'guided_positive'), (2, 'guided_negative')) AS c(cand_idx, candidate)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = each_int(samples(spark, sf_dir, by="sample_id"), range(1, 5), "round")
    grid = each(grid, CANDIDATES, "cand_idx", "candidate")
    index, round_, idx = F.col("sample_index"), F.col("round"), F.col("cand_idx")
    return grid.select(
        "sample_id", "sample_index", "round", "cand_idx", "candidate",
        F.concat(F.lit("Prompt of "), "sample_id", F.lit(" round "), round_.cast("string"),
                 F.lit(" for "), "candidate").alias("prompt"),
        F.when((index + round_ * 3 + idx) % 29 == 0, "  ")
        .when((index + round_) % 17 == 0, "Same feedback. ")
        .otherwise(F.concat(F.lit("Feedback "), "candidate", F.lit(" on "),
                            F.col("custkey").cast("string"), F.lit("/"), round_.cast("string")))
        .alias("response"),
        ((index + round_ + idx) % 31 == 0).alias("truncated"),
    )


# --------------------------------------------------------------------- lengths
SQL_INPUTS["lengths"] = """
SELECT l_orderkey AS request_id, l_linenumber AS batch_index,
       CASE WHEN l_linestatus = 'O' THEN 1024 ELSE 768 END AS max_tokens,
       CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL ELSE
       CAST(least(CASE WHEN l_linestatus = 'O' THEN 1024 ELSE 768 END, floor(l_extendedprice / 80)) AS INT) END AS generated_tokens,
       CASE WHEN l_returnflag = 'R' AND l_extendedprice / 80 >= 768 THEN 'length'
            WHEN l_returnflag = 'A' THEN 'stop' ELSE NULL END AS finish_reason
FROM lineitem"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("l_linestatus") == "O", 1024).otherwise(768)
    size = F.least(limit.cast("double"), F.floor(F.col("l_extendedprice") / 80).cast("double"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("batch_index"),
        limit.alias("max_tokens"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "N"), None)
        .otherwise(size.cast("int"))
        .alias("generated_tokens"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_extendedprice") / 80 >= 768), "length")
        .when(F.col("l_returnflag") == "A", "stop")
        .alias("finish_reason"),
    )


SQL_INPUTS["finished"] = """
SELECT *, coalesce(finish_reason = 'length', false)
          OR coalesce(generated_tokens >= max_tokens, false) AND coalesce(finish_reason, '') NOT IN ('stop', 'abort')
          AS length_finished
FROM lengths"""

# --------------------------------------------------------------------- replies
# One reply per document and role: the whole text, then a line with the answer.
# Eight lines in between keep the end of the text out of the answer's tail.
BRIDGE = "\n\n" + "".join(
    f"line {n}\n" for n in ("one", "two", "three", "four", "five", "six", "seven", "eight")
)
SQL_INPUTS["replies"] = r"""
SELECT doc_id, doc_id * 3 + role_idx AS reply_id, role, role_idx, task_type, gold, label, k, kind,
       CASE WHEN label IS NULL THEN 'none'
            WHEN k % 6 = 0 THEN 'final_result' WHEN k % 6 = 1 THEN 'final_answer'
            WHEN k % 6 = 5 OR (task_type = 'math' AND k % 6 = 3) THEN 'weak_tail'
            ELSE 'tail_claim' END AS source,
       CASE WHEN doc_id % 7 = 0 THEN '<think>' || text || '</think>' || bridge || tail_text
            WHEN doc_id % 11 = 1 THEN '<think>' || text || chr(10) || tail_text
            ELSE text || bridge || tail_text END AS raw,
       doc_id % 7 <> 0 AND doc_id % 11 = 1 AS left_open
FROM (SELECT *, BRIDGE AS bridge, CASE WHEN label IS NULL THEN 'I cannot decide.'
             WHEN k % 6 = 0 THEN 'The final result is ' || label || '.'
             WHEN k % 6 = 1 THEN 'Final Answer: ' || label
             WHEN k % 6 = 2 THEN CASE WHEN task_type = 'math' THEN 'The answer is ' ELSE 'The correct answer is ' END || label || '.'
             WHEN k % 6 = 3 THEN CASE WHEN task_type = 'math' THEN 'Thus ' ELSE 'I choose ' END || label
             WHEN k % 6 = 4 THEN 'Answer: ' || label
             ELSE label END AS tail_text
      FROM (SELECT *, CASE WHEN k = 10 THEN NULL WHEN k < 6 THEN gold
                           WHEN kind = 'word' THEN CASE WHEN gold = 'YES' THEN 'NO' ELSE 'YES' END
                           WHEN kind = 'letter' THEN chr(CAST(65 + (n_chars + 1 + k % 3) % 4 AS INT))
                           ELSE CAST(n_chars + k AS VARCHAR) END AS label
            FROM (SELECT *, CASE kind WHEN 'word' THEN CASE WHEN n_chars % 2 = 0 THEN 'YES' ELSE 'NO' END
                                      WHEN 'letter' THEN chr(CAST(65 + n_chars % 4 AS INT))
                                      ELSE CAST(n_chars AS VARCHAR) END AS gold
                  FROM (SELECT d.*, role_idx, role,
                               CASE doc_id % 4 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'math' ELSE 'mixed' END AS task_type,
                               CASE WHEN doc_id % 4 = 0 OR doc_id % 8 = 3 THEN 'word' WHEN doc_id % 4 = 2 THEN 'number' ELSE 'letter' END AS kind,
                               (doc_id * 31 + n_chars * 17 + role_idx * (13 + doc_id % 7)) % 11 AS k
                        FROM documents d
                        CROSS JOIN (VALUES (0, 'direct'), (1, 'evidence'), (2, 'verification')) AS r(role_idx, role)))))"""


SQL_INPUTS["replies"] = SQL_INPUTS["replies"].replace("BRIDGE", "'" + BRIDGE.replace("\n", "' || chr(10) || '") + "'")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, size, k, label = F.col("doc_id"), F.col("n_chars"), F.col("k"), F.col("label")
    kind, math = F.col("kind"), F.col("task_type") == "math"
    tasks = F.array(*[F.lit(t) for t in ("yes_no", "multiple_choice", "math", "mixed")])
    tail = (
        F.when(label.isNull(), "I cannot decide.")
        .when(k % 6 == 0, F.concat(F.lit("The final result is "), label, F.lit(".")))
        .when(k % 6 == 1, F.concat(F.lit("Final Answer: "), label))
        .when(k % 6 == 2, F.concat(F.when(math, "The answer is ").otherwise("The correct answer is "), label, F.lit(".")))
        .when(k % 6 == 3, F.concat(F.when(math, "Thus ").otherwise("I choose "), label))
        .when(k % 6 == 4, F.concat(F.lit("Answer: "), label))
        .otherwise(label)
    )
    nl, below = F.lit("\n"), F.lit(BRIDGE)
    open_think = (doc % 7 != 0) & (doc % 11 == 1)
    return (
        each(table(spark, sf_dir, "documents"), ROLES, "role_idx", "role")
        .withColumn("task_type", F.element_at(tasks, (doc % 4 + 1).cast("int")))
        .withColumn(
            "kind",
            F.when((doc % 4 == 0) | (doc % 8 == 3), "word").when(doc % 4 == 2, "number").otherwise("letter"),
        )
        .withColumn("k", (doc * 31 + size * 17 + F.col("role_idx") * (doc % 7 + 13)) % 11)
        .withColumn(
            "gold",
            F.when(kind == "word", F.when(size % 2 == 0, "YES").otherwise("NO"))
            .when(kind == "letter", _letter(size % 4))
            .otherwise(size.cast("string")),
        )
        .withColumn(
            "label",
            F.when(k == 10, None)
            .when(k < 6, F.col("gold"))
            .when(kind == "word", F.when(F.col("gold") == "YES", "NO").otherwise("YES"))
            .when(kind == "letter", _letter((size + 1 + k % 3) % 4))
            .otherwise((size + k).cast("string")),
        )
        .withColumn("tail_text", tail)
        .withColumn(
            "raw",
            F.when(doc % 7 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"), below, "tail_text"))
            .when(doc % 11 == 1, F.concat(F.lit("<think>"), "text", nl, "tail_text"))
            .otherwise(F.concat("text", below, "tail_text")),
        )
        .select(
            "doc_id", (doc * 3 + F.col("role_idx")).alias("reply_id"), "role", "role_idx",
            "task_type", "gold", "label", "k", "kind", "raw", open_think.alias("left_open"),
        )
    )


# Answers the extractor is expected to give for each reply.
SQL_INPUTS["expected_answers"] = """
SELECT reply_id, doc_id, role, role_idx, task_type, gold,
       CASE WHEN NOT left_open THEN label END AS answer,
       CASE WHEN left_open THEN 'none' ELSE source END AS source,
       left_open
FROM replies"""

# ---------------------------------------------------------------- answer forms
# The ways an answer may be written, over every order.
SQL_INPUTS["answer_forms"] = r"""
SELECT sample_index, sample_id,
       CASE (sample_index // 12) % 4 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'mixed' ELSE 'other' END AS task_type,
       CASE sample_index % 12 WHEN 0 THEN '(' || lower(letter) || ')' WHEN 1 THEN letter || '.' WHEN 2 THEN ' yes '
            WHEN 3 THEN 'Yeah' WHEN 4 THEN 'y' WHEN 5 THEN 'No.' WHEN 6 THEN '' WHEN 7 THEN NULL
            WHEN 8 THEN '__UNSCORABLE__' WHEN 9 THEN '((' || letter || ')).' WHEN 10 THEN 'N' ELSE letter || letter END AS answer,
       CASE custkey % 7 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE letter END AS gold
FROM (SELECT *, chr(CAST(65 + custkey % 5 AS INT)) AS letter FROM samples)"""


def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, letter = F.col("sample_index"), _letter(F.col("custkey") % 5)
    kinds = F.array(*[F.lit(t) for t in ("yes_no", "multiple_choice", "mixed", "other")])
    form, gold = index % 12, F.col("custkey") % 7
    return samples(spark, sf_dir).select(
        "sample_index", "sample_id",
        F.element_at(kinds, (F.floor(index / 12) % 4 + 1).cast("int")).alias("task_type"),
        F.when(form == 0, F.concat(F.lit("("), F.lower(letter), F.lit(")")))
        .when(form == 1, F.concat(letter, F.lit(".")))
        .when(form == 2, " yes ").when(form == 3, "Yeah").when(form == 4, "y").when(form == 5, "No.")
        .when(form == 6, "").when(form == 7, None).when(form == 8, "__UNSCORABLE__")
        .when(form == 9, F.concat(F.lit("(("), letter, F.lit(")).")))
        .when(form == 10, "N").otherwise(F.concat(letter, letter)).alias("answer"),
        F.when(gold == 0, "YES").when(gold == 1, "no").when(gold == 2, None).when(gold == 3, "")
        .otherwise(letter).alias("gold"),
    )


SQL_INPUTS["math_forms"] = r"""
SELECT sample_index, a, b, CASE form WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN a || '.0' WHEN 2 THEN '\frac{' || a || '}{' || b || '}'
            WHEN 3 THEN '\dfrac{' || a || '}{' || b || '}' WHEN 4 THEN '\text{' || a || '}' WHEN 5 THEN 'x +  ' || a
            WHEN 6 THEN ' ' || a || ' ' WHEN 7 THEN a || 'e0' WHEN 8 THEN '' ELSE NULL END AS answer,
       CASE form WHEN 2 THEN a / b WHEN 3 THEN a / b WHEN 5 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE a END AS number,
       CASE other WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN CAST(a + 1 AS VARCHAR) WHEN 2 THEN 'x + ' || a
            WHEN 3 THEN '\frac{' || (a * 2) || '}{' || (b * 2) || '}' ELSE '' END AS gold,
       CASE other WHEN 0 THEN a WHEN 1 THEN a + 1 WHEN 3 THEN a / b ELSE NULL END AS gold_number, form, other
FROM (SELECT sample_index, custkey % 97 AS a, 1 + custkey % 4 AS b, sample_index % 10 AS form, (sample_index // 10) % 5 AS other FROM samples)"""


def math_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = samples(spark, sf_dir).select(
        "sample_index", (F.col("custkey") % 97).alias("a"), (F.col("custkey") % 4 + 1).alias("b"),
        (F.col("sample_index") % 10).alias("form"), (F.floor(F.col("sample_index") / 10) % 5).alias("other"),
    )
    a, b, form, other = (F.col(c).cast("string") if c in "ab" else F.col(c) for c in ("a", "b", "form", "other"))

    def frac(name: str, x: Column, y: Column) -> Column:
        return F.concat(F.lit(name + "{"), x, F.lit("}{"), y, F.lit("}"))

    twice = [(F.col(c) * 2).cast("string") for c in ("a", "b")]
    return base.select(
        "sample_index",
        F.when(form == 0, a).when(form == 1, F.concat(a, F.lit(".0"))).when(form == 2, frac("\\frac", a, b))
        .when(form == 3, frac("\\dfrac", a, b)).when(form == 4, F.concat(F.lit("\\text{"), a, F.lit("}")))
        .when(form == 5, F.concat(F.lit("x +  "), a)).when(form == 6, F.concat(F.lit(" "), a, F.lit(" ")))
        .when(form == 7, F.concat(a, F.lit("e0"))).when(form == 8, "").alias("answer"),
        F.when(other == 0, a).when(other == 1, (F.col("a") + 1).cast("string"))
        .when(other == 2, F.concat(F.lit("x + "), a)).when(other == 3, frac("\\frac", *twice)).otherwise("").alias("gold"),
    )


# SQL forms of the label rules, written independently of the Spark columns.
def sql_match_label(value: str, task: str) -> str:
    label = f"upper(trim(trim(trim(coalesce({value}, '')), '()'), '.'))"
    return (
        f"CASE WHEN {task} IN ('yes_no', 'mixed') AND {label} IN ('YES', 'Y') THEN 'Y' "
        f"WHEN {task} IN ('yes_no', 'mixed') AND {label} IN ('NO', 'N') THEN 'N' "
        f"ELSE substr({label}, 1, 1) END"
    )


def sql_vote_label(value: str, task: str) -> str:
    label = f"upper(trim(trim(trim({value}), '().'), '.'))"
    word = f"CASE WHEN {label} IN ('YES', 'Y') THEN 'YES' WHEN {label} IN ('NO', 'N') THEN 'NO' END"
    letter = f"CASE WHEN regexp_full_match({label}, '[A-Z]') THEN {label} END"
    return (
        f"CASE WHEN trim({value}) = '' THEN NULL WHEN {task} = 'yes_no' THEN {word} "
        f"WHEN {task} = 'multiple_choice' THEN {letter} WHEN {task} = 'mixed' THEN coalesce({letter}, {word}) "
        f"ELSE trim({value}) END"
    )

# ------------------------------------------------------- texts with known result
# Whole document texts reduced to words, wrapped in the debris the cleaner removes.
SQL_INPUTS["debris"] = r"""
SELECT doc_id, words, letter, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w2
FROM (SELECT doc_id, text, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS words,
             chr(CAST(65 + doc_id % 4 AS INT)) AS letter FROM documents)"""


def debris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("words"),
        _letter(F.col("doc_id") % 4).alias("letter"),
    )


SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


# ---------------------------------------------------------------- result cells
# Accuracy per model, dataset, run and round; the customer picks the model.
MODEL_NAMES = ("Llama3-8B", "mistral_7b", "gemma-2-2b", "phi4_mini", "qwen25_3b")
RUNS = ("sft_only", "sft_base_critic", "sft_trained_critic", "no_sft_full", "full")
SQL_INPUTS["cells"] = f"""
SELECT [{", ".join(f"'{m}'" for m in MODEL_NAMES)}][1 + (custkey % 5)::INT] AS model, dataset,
       [{", ".join(f"'{r}'" for r in RUNS)}][1 + ((sample_index // 5) % 5)::INT] AS source, round,
       count(*) AS samples, count(*) FILTER (WHERE coalesce(label = gold, false)) / count(*) AS accuracy,
       count(label) / count(*) AS parse_rate
FROM completions GROUP BY ALL"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one_of(names, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (index % 5 + 1).cast("int"))

    rows = completions(spark, sf_dir)
    hit = F.coalesce(F.col("label") == F.col("gold"), F.lit(False))
    n = F.count(F.lit(1))
    return rows.groupBy(
        one_of(MODEL_NAMES, F.col("custkey")).alias("model"), "dataset",
        one_of(RUNS, F.floor(F.col("sample_index") / 5)).alias("source"), "round",
    ).agg(n.alias("samples"), (F.count_if(hit) / n).alias("accuracy"), (F.count("label") / n).alias("parse_rate"))
