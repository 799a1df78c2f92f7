"""Sources, sinks, manifests and streams: tables are written to the shared
folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F


from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.functions.fingerprint import table_fingerprint
from plenum.operators import joins, metrics, quality, records as rec, standardize
from plenum.schemas import simple
from plenum.session import scratch_path
from plenum.sources import benchmarks, hashtree, manifest, records, sinks
from plenum.streaming import incremental

ROW = simple("sample_id string, sample_index bigint, dataset string, gold string")


def index():
    return F.col("sample_index")


# --------------------------------------------------------------------- records


def jsonl_line():
    """A record as a line; some blank, some broken, some arrays."""
    good = F.to_json(F.struct("sample_id", "sample_index", "dataset", F.when(index() % 7 > 0, F.col("gold")).alias("gold")), {"ignoreNullFields": "false"})
    return (
        F.when(index() % 50 == 1, "[{\"sample_id\": \"x\"}]").when(index() % 50 == 2, "{\"sample_id\": ")
        .when(index() % 50 == 3, "   ").when(index() % 50 == 4, "{\"sample_id\": \"a\", \"sample_index\": \"text\"}").otherwise(good)
    )


def jsonl_lines(spark, d):
    path = scratch_path(spark, "jsonl")
    inputs.samples(spark, d).select(jsonl_line().alias("value")).write.text(path)
    return path


@query(
    "scan_jsonl",
    "SELECT sample_id, sample_index, dataset, CASE WHEN sample_index % 7 > 0 THEN gold END AS gold FROM samples WHERE sample_index % 50 NOT IN (1, 2, 3, 4)",
)
def scan_jsonl(spark, d):
    return records.scan_jsonl(spark, jsonl_lines(spark, d), ROW, strict=False)


@query(
    "count_jsonl",
    """SELECT count(*) FILTER (WHERE sample_index % 50 NOT IN (1, 2, 3, 4)) AS rows, count(*) FILTER (WHERE sample_index % 50 IN (1, 2, 4)) AS broken FROM samples""",
)
def count_jsonl(spark, d):
    path = jsonl_lines(spark, d)
    clean = scratch_path(spark, "clean")
    sinks.write_jsonl(records.scan_jsonl(spark, path, ROW, strict=False), clean)
    whole = records.count_jsonl(spark, clean, ROW)
    broken = records.jsonl_violations(spark, path, ROW).agg(F.count(F.lit(1)).alias("broken"))
    return broken.select(F.lit(whole).cast("bigint").alias("rows"), "broken")


@query(
    "jsonl_line_numbers",
    """SELECT part, line_no, CASE sample_index % 50 WHEN 1 THEN '[{"sample_id": "x"}]' WHEN 2 THEN '{"sample_id": ' ELSE '{"sample_id": "a", "sample_index": "text"}' END AS value
       FROM (SELECT sample_index, custkey % 8 AS part, row_number() OVER (PARTITION BY custkey % 8 ORDER BY sample_index) AS line_no FROM samples)
       WHERE sample_index % 50 IN (1, 2, 4)""",
)
def jsonl_line_numbers(spark, d):
    """Broken lines of eight files with their line numbers; blank lines count."""
    path = scratch_path(spark, "parts")
    rows = inputs.samples(spark, d).select("sample_index", (F.col("custkey") % 8).alias("part"), jsonl_line().alias("value"))
    rows.repartition(8, "part").sortWithinPartitions("part", "sample_index").drop("sample_index").write.partitionBy("part").text(path)
    found = records.jsonl_violations(spark, path, ROW)
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("bigint")
    return found.select(part.alias("part"), F.col("line_no").cast("bigint").alias("line_no"), "value")


DECIDED = simple("sample_id string, round int, answer string, correct boolean")


@query(
    "scan_jsonl_gz",
    """SELECT variant, dataset, sample_id, round, final AS answer, coalesce(final = gold, false) AS correct
       FROM ballots CROSS JOIN (VALUES ('full'), ('half')) AS f(variant)
       WHERE dataset <> 'arc' AND (variant = 'full' OR dataset = 'boolq') AND sample_index % 50 <> 9""",
)
def scan_jsonl_gz(spark, d):
    from plenum.catalog.voting import decided

    path = scratch_path(spark, "decisions")
    row = F.struct("sample_id", F.col("round").cast("int").alias("round"), "decision.answer", F.col("decision_correct").alias("correct"))
    line = F.to_json(row, {"ignoreNullFields": "false"})
    # one decision in 50 is cut off
    rows = decided(spark, d).select(
        F.col("dataset").alias("cell"), F.when(F.col("sample_index") % 50 == 9, F.substring(line, 1, 20)).otherwise(line).alias("value")
    )
    # two folders with files of equal names; a cell has a file of each task that decides, so no file grows with the table
    for variant in ("full", "half"):
        some = rows if variant == "full" else rows.filter("cell = 'boolq'")
        some.write.partitionBy("cell").option("compression", "gzip").text(f"{path}/{variant}")
    stored = scratch_path(spark, "inventory")
    manifest.inventory(spark, path).write.parquet(stored)  # files are digested once for it, not whenever it is read
    listed = spark.read.parquet(stored)
    cells = listed.select(
        "path", "sha256", F.regexp_extract("path", "^([a-z]+)/", 1).alias("variant"), F.regexp_extract("path", "cell=([a-z]+)/", 1).alias("dataset")
    ).filter("path like '%.txt.gz'")
    # the manifest names no file of the last data set
    rows = records.scan_manifest_files(spark, path, DECIDED, cells.filter("dataset != 'arc'"), strict=False)
    return rows.select("variant", "dataset", "sample_id", "round", "answer", "correct")


SCORED = "SELECT dataset, role, count(*) AS samples, count(*) FILTER (WHERE correct) AS correct FROM votes GROUP BY ALL"


def scored(spark, d):
    return metrics.score_counts(inputs.votes(spark, d), ["dataset", "role"]).select("dataset", "role", "samples", "correct")


@query("scan_json_document", SCORED)
def scan_json_document(spark, d):
    path = scratch_path(spark, "documents")
    docs = sinks.metrics_documents(scored(spark, d), ["dataset", "role"])
    docs.repartition("dataset", "role").write.partitionBy("dataset", "role").text(path)
    return records.scan_documents(
        spark, path, simple("samples bigint, correct bigint"),
        {"dataset": "dataset=([^/]+)/", "role": "role=([^/]+)/"},
    )


ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_note"]


@query(
    "scan_csv_no_missing",
    """SELECT 'o_note' AS column, count(*) AS cells FROM orders WHERE o_orderkey % 6 IN (1, 2, 3, 4)
       UNION ALL SELECT 'typed', count(*) FILTER (WHERE o_orderkey % 6 NOT IN (1, 2, 3, 4)) FROM orders""",
)
def scan_csv_no_missing(spark, d):
    key = F.col("o_orderkey")
    note = F.when(key % 6 == 1, " N/A").when(key % 6 == 2, "--").when(key % 6 == 3, "").when(key % 6 == 4, "NaN").otherwise("fine")
    rows = inputs.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", note.alias("o_note"))
    path, clean = scratch_path(spark, "csv"), scratch_path(spark, "csv-clean")
    rows.write.option("header", True).csv(path)
    rows.filter("o_note = 'fine'").write.option("header", True).csv(clean)
    bad = records.missing_cells(records.read_csv_text(spark, path, ORDER_COLUMNS))
    typed = records.scan_csv(spark, clean, simple("o_orderkey bigint, o_orderstatus string, o_note string"))
    n = F.count(F.lit(1)).alias("cells")
    return bad.groupBy("column").agg(n).unionByName(
        typed.filter(F.col("o_orderkey") >= 0).agg(n).select(F.lit("typed").alias("column"), "cells")
    )


# ------------------------------------------------------------------ benchmarks


@query(
    "scan_parquet_splits",
    "SELECT doc_id, source, lang AS source_split, (SELECT count(*) FROM documents WHERE lang = 'fr') AS wrong_size FROM documents",
)
def scan_parquet_splits(spark, d):
    root = scratch_path(spark, "splits")
    docs = inputs.table(spark, d, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 2 == 0, "easy").otherwise("hard").alias("part"))
    docs.write.partitionBy("lang", "part").parquet(root)
    languages = ("de", "en", "es", "fr")
    # expected sizes come from the staged table, not from the files; one of them is off by one
    counts = inputs.table(spark, d, "documents").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in languages]).first().asDict()
    files = {lang: [f"{root}/lang={lang}/part={p}" for p in ("easy", "hard")] for lang in languages}
    try:
        benchmarks.scan_splits(spark, files, counts | {"fr": counts["fr"] + 1})
        found = 0
    except quality.ContractError as refused:
        found = int(str(refused).split("'actual': ")[1].rstrip("}"))
    rows = benchmarks.scan_splits(spark, files, counts)
    return rows.select("doc_id", "source", "source_split", F.lit(found).cast("bigint").alias("wrong_size"))


@query(
    "scan_nested_examples",
    """SELECT replace(p_type, ' ', '_') || '-' || (p_partkey // 100) AS subject, row_number() OVER (PARTITION BY p_type, p_partkey // 100 ORDER BY p_partkey) - 1 AS source_index,
              p_name AS input, p_brand AS target FROM part""",
)
def scan_nested_examples(spark, d):
    root = scratch_path(spark, "examples")
    named = inputs.table(spark, d, "part").withColumn(
        "subject", F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("-"), F.floor(F.col("p_partkey") / 100).cast("string"))
    )
    example_files(named, root)
    return benchmarks.scan_examples(spark, root, named.select("subject").distinct())


def example_files(named, root):
    """One JSON file per subject, named after it; a subject has at most 100 parts, so they fit one document."""
    example = F.struct("p_partkey", F.col("p_name").alias("input"), F.col("p_brand").alias("target"))
    docs = named.groupBy("subject").agg(F.to_json(F.struct(F.array_sort(F.collect_list(example)).alias("examples"))).alias("value"))
    # Spark names files itself: the subject goes into the folder and is read from there
    docs.repartition("subject").write.partitionBy("subject").text(root)


SETS_SQL = """
SELECT dataset, split, count(*) AS rows, min(i) AS first_index, max(i) AS last_index, count(DISTINCT question) AS questions, min(answer) AS least_answer, max(answer) AS most_answer
FROM (SELECT 'boolq' AS dataset, CASE WHEN p_partkey % 3 = 0 THEN 'validation' ELSE 'train' END AS split, row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY p_partkey) - 1 AS i,
             p_name AS question, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM part
      UNION ALL SELECT 'mmlu', CASE p_partkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'dev' END, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1,
             p_name, chr(CAST(65 + p_size % 4 AS INT)) FROM part
      UNION ALL SELECT 'sciq', CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1, p_name, NULL FROM part
      UNION ALL SELECT 'arc', CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1,
             p_name, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END FROM part
      UNION ALL SELECT s, CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END, row_number() OVER (PARTITION BY s, p_partkey % 2 ORDER BY p_partkey) - 1, p_name, CAST(p_size AS VARCHAR)
             FROM part CROSS JOIN (VALUES ('math'), ('gsm8k')) AS v(s))
GROUP BY ALL
UNION ALL
SELECT 'bbh', split, CASE split WHEN 'test' THEN test WHEN 'validation' THEN validation ELSE total - test - validation END AS rows, 0,
       CASE split WHEN 'test' THEN test WHEN 'validation' THEN validation ELSE total - test - validation END - 1, NULL, NULL, NULL
FROM (SELECT sum(n)::BIGINT AS total, CASE WHEN sum(n) >= 1760 THEN 1260 ELSE sum(floor(n * 0.25)) END::BIGINT AS test,
             CASE WHEN sum(n) >= 1760 THEN 500 ELSE sum(floor(n * 0.10)) END::BIGINT AS validation
      FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey % 22))
CROSS JOIN (VALUES ('test'), ('validation'), ('train')) AS v(split)"""


@query("dataset_registry_scan", SETS_SQL)
def dataset_registry_scan(spark, d):
    """All seven data sets, staged in their own source shapes and loaded through the registry."""
    root = scratch_path(spark, "registry")
    part = inputs.table(spark, d, "part")
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    letters = F.array(*[F.concat(name, F.lit(f" {x}")) for x in "wxyz"])
    shapes = {
        "boolq": [name.alias("question"), F.col("p_type").alias("passage"), (size % 2 == 0).alias("answer")],
        "mmlu": [name.alias("question"), letters.alias("choices"), (size % 4).cast("int").alias("answer"), F.col("p_type").alias("subject")],
        "sciq": [
            name.alias("question"), F.col("p_type").alias("correct_answer"), F.col("p_brand").alias("distractor1"),
            F.concat(name, F.lit("2")).alias("distractor2"), F.concat(name, F.lit("3")).alias("distractor3"), F.lit("").alias("support"),
        ],
        "arc": [
            name.alias("question"),
            F.struct(F.slice(letters, 1, 2).alias("text"), F.array(F.lit("1"), F.lit("2")).alias("label")).alias("choices"),
            (size % 2 + 1).cast("string").alias("answerKey"),
        ],
        "math": [name.alias("problem"), F.concat(F.lit("so \\boxed{"), size.cast("string"), F.lit("}")).alias("solution")],
        "gsm8k": [name.alias("question"), F.concat(F.lit("sum\n#### "), size.cast("string")).alias("answer")],
    }
    outs = []
    for dataset, columns in shapes.items():
        splits = benchmarks.REGISTRY[dataset].splits
        for at, split in enumerate(splits):
            held = key % 3 == 0 if dataset == "boolq" else None
            mine = (held if at else ~held) if held is not None else key % len(splits) == at
            part.filter(mine).select(key, *columns).write.parquet(f"{root}/{dataset}/{split}")
        sizes = {s: spark.read.parquet(f"{root}/{dataset}/{s}").count() for s in splits} if dataset == "arc" else None
        loaded = benchmarks.load_dataset(spark, dataset, root, "p_partkey", sizes=sizes)
        answer = F.when(F.lit(dataset != "sciq"), F.col("answer")).alias("answer")
        outs.append(loaded.select(F.lit(dataset).alias("dataset"), "split", "source_index", "question", answer))
    choice, yes = standardize.BBH_MULTIPLE_CHOICE, standardize.BBH_CATEGORIES
    category = F.element_at(F.array(*[F.lit(c) for c in yes]), (key % len(yes) + 1).cast("int"))
    named = part.withColumn("subject", category)
    many = F.col("subject").isin(*choice)
    shaped = named.select(
        "subject", "p_partkey", F.when(many, F.concat(name, F.lit("\nOptions:\n(A) x\n(B) y"))).otherwise(name).alias("p_name"),
        F.when(many, "(B)").otherwise("yes").alias("p_brand"),
    )
    example_files(shaped, f"{root}/bbh")
    bbh = benchmarks.load_dataset(spark, "bbh", root, "p_partkey")
    empty = F.lit(None).cast("string")
    outs.append(bbh.select("dataset", "split", "source_index", empty.alias("question"), empty.alias("answer")))
    rows = joins.union_parts(outs, strict=True)
    count = F.countDistinct("question")
    return rows.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("source_index").alias("first_index"), F.max("source_index").alias("last_index"),
        F.when(F.col("dataset") != "bbh", count).alias("questions"), F.min("answer").alias("least_answer"), F.max("answer").alias("most_answer"),
    )


@query(
    "split_mapping",
    """SELECT sample_index, source_split, CASE source_split WHEN 'auxiliary_train' THEN 'train' ELSE source_split END AS split,
              coalesce(subject, CASE source_split WHEN 'auxiliary_train' THEN 'auxiliary_train' ELSE 'unknown' END) AS subject
       FROM (SELECT sample_index, ['auxiliary_train', 'validation', 'test', 'dev'][1 + (custkey % 4)::INT] AS source_split, CASE WHEN custkey % 4 > 0 AND custkey % 7 > 0 THEN subject END AS subject FROM samples)""",
)
def split_mapping(spark, d):
    cust = F.col("custkey")
    names = F.array(*[F.lit(x) for x in ("auxiliary_train", "validation", "test", "dev")])
    rows = inputs.samples(spark, d).select(
        "sample_index", F.element_at(names, (cust % 4 + 1).cast("int")).alias("source_split"),
        F.when((cust % 4 > 0) & (cust % 7 > 0), F.col("subject")).alias("subject"),
    )
    return benchmarks.map_splits(rows, "by_subject")


# ----------------------------------------------------------------------- sinks


@query(
    "sink_jsonl",
    "SELECT sample_id, sample_index, dataset, CASE WHEN sample_index % 7 > 0 THEN gold END AS gold, (SELECT count(*) FROM samples) AS written FROM samples",
)
def sink_jsonl(spark, d):
    path = scratch_path(spark, "sink")
    rows = inputs.samples(spark, d).select(
        "sample_id", "sample_index", "dataset", F.when(index() % 7 > 0, F.col("gold")).alias("gold")
    )
    sinks.write_jsonl(rows.withColumn("dataset", F.lit("old")), path)  # an older output, replaced as a whole
    written = sinks.write_jsonl(rows, path, ["sample_index"])
    return records.scan_jsonl(spark, path, ROW).withColumn("written", F.lit(written).cast("bigint"))


@query(
    "sink_json_metrics",
    f"""SELECT *, '{{"correct":' || correct || ',"samples":' || samples || '}}' AS document FROM ({SCORED})""",
)
def sink_json_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(scored(spark, d), path, ["dataset", "role"])
    back = spark.read.parquet(path)
    return sinks.metrics_documents(back, ["dataset", "role"]).join(back, ["dataset", "role"])


@query(
    "sink_csv_summary",
    """SELECT model, source AS method, dataset, sum(samples)::BIGINT AS samples, avg(accuracy) > 0 AS scored FROM cells GROUP BY ALL""",
)
def sink_csv_summary(spark, d):
    path = scratch_path(spark, "summary")
    results = inputs.cells(spark, d).groupBy("model", F.col("source").alias("method"), "dataset").agg(
        F.sum("samples").alias("samples"), F.avg("accuracy").alias("accuracy")
    )
    sinks.write_csv_summary(results, path)
    schema = simple("model string, method string, dataset string, samples bigint, accuracy double")
    back = records.scan_csv(spark, path, schema)
    return back.select("model", "method", "dataset", "samples", (F.col("accuracy") > 0).alias("scored"))


# ------------------------------------------------------------------- manifests


@query(
    "stage_manifest",
    """SELECT o_orderstatus AS stage, CASE o_orderstatus WHEN 'O' THEN 'complete' ELSE 'stale' END AS status, 1 AS artifacts FROM orders GROUP BY ALL
       UNION ALL SELECT 'X', 'missing', 0""",
)
def stage_manifest(spark, d):
    """Stage F has another fingerprint, stage P lost a row, X never ran."""
    rows = inputs.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")

    def described(df):
        return table_fingerprint(df, ["o_orderkey", "o_custkey"], ["o_orderstatus"]).select(
            F.col("o_orderstatus").alias("stage"), F.lit("orders").alias("artifact"), "rows", "content_hash"
        )

    path = scratch_path(spark, "manifest")
    fingerprint = F.when(F.col("stage") == "F", "fp-old").otherwise("fp")
    manifest.record(described(rows).withColumn("fingerprint", fingerprint), path)
    first = rows.filter("o_orderstatus = 'P'").agg(F.min("o_orderkey")).scalar()
    actual = described(rows.filter((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") > first)))
    stages = rows.select(F.col("o_orderstatus").alias("stage")).distinct().unionByName(spark.createDataFrame([("X",)], "stage string"))
    expected = stages.withColumn("fingerprint", F.lit("fp"))
    return manifest.stage_status(expected, manifest.load(spark, path), actual)


HASH_WIDTH, HASH_FANOUT = 64, 4


@query(
    "stage_hash_tree",
    f"""WITH cut AS (SELECT o_orderstatus AS stage, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
             leaf AS (SELECT o_orderstatus AS stage, o_orderkey // {HASH_WIDTH} AS "range", count(*) AS n FROM orders GROUP BY ALL),
             diff AS (SELECT stage, "range", n AS rows_before, n - CASE stage WHEN 'P' THEN 1 ELSE 0 END AS rows_now
                      FROM leaf JOIN cut USING (stage) WHERE "range" = k // {HASH_WIDTH})
        SELECT v.stage, v.status, v.cause, d."range", d."range" * {HASH_WIDTH} AS first_key, d.rows_before, nullif(d.rows_now, 0) AS rows_now
        FROM (VALUES ('F', 'complete', NULL), ('O', 'stale', NULL), ('P', 'stale', NULL), ('closed', 'complete', NULL), ('open', 'stale', 'O'),
                     ('all', 'stale', 'O'), ('report', 'stale', 'O')) AS v(stage, status, cause)
        LEFT JOIN diff d USING (stage)""",
)
def stage_hash_tree(spark, d):
    """Trees of the orders by status: one changed row in O, one row less in P, and the stages that follow."""
    rows = inputs.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    least = rows.filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("s")).agg(F.min("o_orderkey").alias("k"))
    at = {r["s"]: r["k"] for r in least.collect()}  # one row a status
    hit = lambda s: (F.col("o_orderstatus") == s) & (F.col("o_orderkey") == at.get(s, -1))
    after = rows.filter(~hit("P")).withColumn("o_custkey", F.when(hit("O"), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    found = None
    for stage in ("F", "O", "P"):
        tree = lambda df: hashtree.hash_tree(
            df.filter(F.col("o_orderstatus") == stage), "o_orderkey", ["o_orderkey", "o_custkey"], HASH_WIDTH, HASH_FANOUT
        )
        part = hashtree.changed_ranges(tree(rows), tree(after), HASH_WIDTH, HASH_FANOUT).withColumn("stage", F.lit(stage))
        found = part if found is None else found.unionByName(part)
    names = ["F", "O", "P", "closed", "open", "all", "report"]
    edges = [("closed", "F"), ("open", "O"), ("all", "open"), ("all", "closed"), ("all", "P"), ("report", "all")]
    stages = spark.createDataFrame([(n,) for n in names], "stage string")
    status = stages.join(found.select("stage", F.lit("stale").alias("status")).distinct(), "stage", "left").fillna("complete", ["status"])
    carried = hashtree.carry_staleness(status, spark.createDataFrame(edges, "stage string, upstream string"))
    return carried.join(found.select("stage", "range", "first_key", "rows_before", "rows_now"), "stage", "left")


@query(
    "check_upstream_stage",
    """SELECT o_orderpriority AS stage, o_orderstatus AS artifact, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'missing' WHEN '2' THEN 'stale' WHEN '3' THEN 'redirected' ELSE 'corrupted' END AS reason
       FROM orders WHERE substr(o_orderpriority, 1, 1) < '5' GROUP BY ALL""",
)
def check_upstream_stage(spark, d):
    found = inputs.table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("artifact")
    ).agg(F.sum("o_orderkey").cast("string").alias("content_hash"))
    kind = F.substring("stage", 1, 1)
    expected = found.select("*", F.lit("fp").alias("fingerprint"), F.concat(F.lit("/data/"), "stage").alias("path"))
    stored = expected.filter(kind != "1").select(
        "stage", "artifact", F.when(kind == "2", "old").otherwise("fp").alias("fingerprint"),
        F.when(kind == "3", "/elsewhere").otherwise(F.col("path")).alias("path"),
        F.when(kind == "4", "0").otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return manifest.blocked_inputs(expected, stored)


@query(
    "join_shard_markers",
    """SELECT dataset AS stage, shard, CASE WHEN shard % 5 = 1 THEN 'missing' ELSE 'stale' END AS reason
       FROM (SELECT DISTINCT dataset, custkey % 16 AS shard FROM samples) WHERE shard % 5 IN (1, 2)""",
)
def join_shard_markers(spark, d):
    shard = (F.col("custkey") % 16).alias("shard")
    expected = inputs.samples(spark, d).groupBy(F.col("dataset").alias("stage"), shard).agg(
        F.sha2(F.sum("sample_index").cast("string"), 256).alias("fingerprint")
    )
    markers = expected.filter("shard % 5 != 1").withColumn(
        "fingerprint", F.when(F.col("shard") % 5 == 2, "old").otherwise(F.col("fingerprint"))
    )
    return manifest.shard_blockers(expected, markers)


@query(
    "inventory_check",
    """SELECT 'chunk=' || chunk AS path, CASE chunk % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' ELSE 'hash' END AS problem
       FROM (SELECT DISTINCT doc_id // 20 AS chunk FROM documents) WHERE chunk % 5 IN (1, 2, 3)""",
)
def inventory_check(spark, d):
    root = scratch_path(spark, "inventory")
    chunk = F.floor(F.col("doc_id") / 20).alias("chunk")
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", chunk)
    stored = docs.filter(F.col("chunk") % 5 != 1)
    stored.repartition("chunk").sortWithinPartitions("chunk", "doc_id").drop("doc_id").write.partitionBy("chunk").text(root)
    # what the files must hold: at most 20 documents per file
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
    body = docs.groupBy("chunk").agg(F.array_join(ordered, "").alias("body"))
    kind = F.col("chunk") % 5
    listed = body.select(
        F.concat(F.lit("chunk="), F.col("chunk").cast("string")).alias("path"),
        (F.octet_length("body") + F.when(kind == 2, 1).otherwise(0)).cast("bigint").alias("bytes"),
        F.when(kind == 3, "0" * 64).when(kind != 4, F.sha2("body", 256)).alias("sha256"),
    )
    files = manifest.inventory(spark, root).filter("path like '%.txt'").withColumn("path", F.regexp_extract("path", "^(.*)/", 1))
    return manifest.inventory_problems(files, listed)


# --------------------------------------------------------------------- streams
EVENT = simple("event_id bigint, user_id bigint, event_type string, round int, gold string, text string")
STREAM_SQL = """
SELECT event_id, user_id, event_type, (event_id % 5)::INT AS round, chr(CAST(65 + user_id % 4 AS INT)) AS gold,
       CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 < 4 THEN chr(CAST(65 + user_id % 4 AS INT)) ELSE chr(CAST(65 + (user_id + 1) % 4 AS INT)) END AS answer
FROM events WHERE event_id % 41 NOT IN (7, 8)"""


def event_files(spark, d):
    """Events as answered records in several JSON-lines files."""
    event, user = F.col("event_id"), F.col("user_id")
    right, wrong = F.char((user % 4 + 65).cast("int")), F.char(((user + 1) % 4 + 65).cast("int"))
    text = F.when(event % 7 == 6, "I cannot decide.").when(event % 7 < 4, F.concat(F.lit("Thinking.\nFinal Answer: "), right)).otherwise(
        F.concat(F.lit("I choose "), wrong)
    )
    path = scratch_path(spark, "events")
    row = F.struct("event_id", "user_id", "event_type", (event % 5).cast("int").alias("round"), right.alias("gold"), text.alias("text"))
    # some lines are cut off, some are no object
    line = F.when(event % 41 == 7, F.substring(F.to_json(row), 1, 15)).when(event % 41 == 8, F.lit("[]")).otherwise(F.to_json(row))
    inputs.table(spark, d, "events").repartition(6).select(line.alias("value")).write.text(path)
    return path


def answered(stream):
    task = stream.withColumn("task_type", F.lit("multiple_choice"))
    return rec.with_answer(task, "text", "task_type", "gold").select(
        "event_id", "user_id", "event_type", "round", "answer", "parsed", "correct", *(["_broken"] if "_broken" in stream.columns else [])
    )


@query("stream_incremental_scoring", f"""SELECT event_id, round, answer, answer IS NOT NULL AS parsed, coalesce(answer = gold, false) AS correct,
          (SELECT count(*) FROM events WHERE event_id % 41 IN (7, 8)) AS broken_lines FROM ({STREAM_SQL})""")
def stream_incremental_scoring(spark, d):
    source, target = event_files(spark, d), scratch_path(spark, "scored")
    stream = incremental.record_stream(spark, source, EVENT, files_per_batch=3)
    bad = scratch_path(spark, "broken")
    out = incremental.score_incrementally(stream, answered, target, f"{target}-checkpoint", bad)
    # a second run resumes: there is nothing new to score
    out = incremental.score_incrementally(
        incremental.record_stream(spark, source, EVENT, files_per_batch=3), answered, target, f"{target}-checkpoint", bad
    )
    broken = incremental.broken_lines(spark, target, f"{target}-checkpoint", bad).count()
    return out.select("event_id", "round", "answer", "parsed", "correct", F.lit(broken).cast("bigint").alias("broken_lines"))


@query(
    "stream_commit_log",
    f"""SELECT 'rows' AS "table", 2 AS batches, count(*) AS rows FROM ({STREAM_SQL})
        UNION ALL SELECT 'violations', 2, count(*) FROM events WHERE event_id % 41 IN (7, 8)""",
)
def stream_commit_log(spark, d):
    """What the records of the log say about the tables of a finished run; a killed attempt's folder is not among them."""
    source, target, bad = event_files(spark, d), scratch_path(spark, "scored"), scratch_path(spark, "broken")
    event_rows = inputs.table(spark, d, "events").select("event_id")
    event_rows.write.parquet(f"{target}/attempt=0-stray")
    stream = incremental.record_stream(spark, source, EVENT, files_per_batch=3)
    incremental.score_incrementally(stream, answered, target, f"{target}-checkpoint", bad)
    log = incremental.batch_log(spark, target, f"{target}-checkpoint", None, violations=bad)
    counted = log.manifest().groupBy("table").agg(F.count_distinct("batch").cast("int").alias("batches"), F.sum("rows").alias("rows"))
    return counted.select("table", "batches", "rows")


@query(
    "stream_running_counts",
    f"""SELECT event_type, round, count(*) AS samples, count(*) FILTER (WHERE coalesce(answer = gold, false)) AS correct, count(answer) AS parsed
        FROM ({STREAM_SQL}) GROUP BY event_type, round""",
)
def stream_running_counts(spark, d):
    source, target = event_files(spark, d), scratch_path(spark, "counts")
    stream = incremental.record_stream(spark, source, EVENT, files_per_batch=3)
    return incremental.running_counts(
        answered(stream), ["event_type", "round"], {"correct": "correct", "parsed": "parsed"}, target, f"{target}-checkpoint", fold_every=1
    )


@query("stream_dedup_ids", f"""SELECT event_type, user_id, (SELECT count(*) - count(DISTINCT (event_type, user_id)) FROM ({STREAM_SQL})) AS dropped
        FROM (SELECT DISTINCT event_type, user_id FROM ({STREAM_SQL}))""")
def stream_dedup_ids(spark, d):
    source, target = event_files(spark, d), scratch_path(spark, "dedup")
    stream = incremental.record_stream(spark, source, EVENT, files_per_batch=3).select("event_type", "user_id", "_broken")
    out = incremental.first_of_each_id(stream, ["event_type", "user_id"], target, f"{target}-checkpoint")
    received = records.scan_jsonl(spark, source, EVENT, strict=False)
    dropped = incremental.dropped_rows(received, out).first()["dropped"]
    return out.select("event_type", "user_id", F.lit(dropped).cast("bigint").alias("dropped"))
