"""Benchmark files: registry, split mapping, parquet splits, nested examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import quality, standardize
from plenum.operators.sampling import sample_bundle, source_position, split_stratified

# ---------------------------------------------------------------------------
# Fixed values (data sets, split names and sizes)
ARC_SPLIT_SIZES = {"train": 3370, "validation": 869, "test": 3548}
SPLIT_NAMES = (
    # source split, internal split
    ("auxiliary_train", "train"),
    ("train", "train"),
    ("validation", "validation"),
    ("test", "test"),
    ("dev", "dev"),
)


@dataclass(frozen=True)
class Benchmark:
    task_type: str
    splits: tuple[str, ...]
    layout: str  # parquet: one folder per split; examples: one file per category


REGISTRY = {
    "boolq": Benchmark("yes_no", ("train", "validation"), "parquet"),
    "mmlu": Benchmark("multiple_choice", ("auxiliary_train", "validation", "test", "dev"), "parquet"),
    "bbh": Benchmark("mixed", (), "examples"),
    "sciq": Benchmark("multiple_choice", ("train", "validation", "test"), "parquet"),
    "arc": Benchmark("multiple_choice", ("train", "validation", "test"), "parquet"),
    "math": Benchmark("math", ("train", "test"), "parquet"),
    "gsm8k": Benchmark("math", ("train", "test"), "parquet"),
}
# ---------------------------------------------------------------------------

EXAMPLES_SCHEMA = "examples array<struct<input:string,target:string>>"


def resolve(name: str) -> Benchmark:
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown data set {name!r}; known: {sorted(REGISTRY)}") from None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scan_splits(
    spark: SparkSession, files: Mapping[str, Sequence[str]], sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """Several parquet files per split as one table with the split name.

    A missing file fails before anything is read; sizes are checked if given.
    """
    missing = [p for paths in files.values() for p in paths if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing benchmark files: {missing}")
    parts = [
        spark.read.parquet(*paths).withColumn("source_split", F.lit(split)) for split, paths in files.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if sizes is not None:
        expected = spark.createDataFrame(list(sizes.items()), "source_split string, expected bigint")
        quality.enforce(quality.expected_rows(rows, expected, ["source_split"]), "split size")
    return rows


def scan_examples(spark: SparkSession, folder: str, categories: DataFrame | None = None) -> DataFrame:
    """Category files with an examples list to one row per example.

    The category is the file name, or the folder ``subject=...`` where Spark
    wrote the files; the position in the file is the source index.  Expected
    categories without examples are an error.
    """
    by_folder = F.regexp_extract("_metadata.file_path", r"/subject=([^/]+)/[^/]*$", 1)
    by_name = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    files = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
        .select("value", F.coalesce(F.nullif(by_folder, F.lit("")), by_name).alias("subject"))
    )
    parsed = files.withColumn("d", F.from_json("value", EXAMPLES_SCHEMA))
    bad = parsed.filter(F.col("d").isNull() | (F.coalesce(F.size("d.examples"), F.lit(0)) <= 0))
    quality.enforce(bad.select("subject"), "invalid or empty category file")
    rows = parsed.select("subject", F.posexplode("d.examples").alias("source_index", "e"))
    if categories is not None:
        quality.enforce(categories.join(rows.select("subject").distinct(), "subject", "left_anti"), "missing category")
    return rows.select("subject", F.col("source_index").cast("bigint").alias("source_index"), "e.input", "e.target")


def map_splits(rows: DataFrame, mode: str = "by_subject") -> DataFrame:
    """Source split names to internal ones; the source name is kept.

    Mode ``all`` fills a missing subject with "unknown"; ``by_subject`` marks
    the training rows, which come without subjects.
    """
    if mode not in ("all", "by_subject"):
        raise ValueError(f"unknown load mode {mode!r}")
    # five fixed names: a case expression, not a join
    split = F.lit(None).cast("string")
    for source, name in SPLIT_NAMES:
        split = F.when(F.col("source_split") == source, name).otherwise(split)
    missing = F.when(
        (F.col("source_split") == "auxiliary_train") if mode == "by_subject" else F.lit(False),
        "auxiliary_train",
    ).otherwise("unknown")
    unknown = F.concat(F.lit("unknown split: "), F.coalesce("source_split", F.lit("null")))
    known = F.coalesce(split, F.raise_error(unknown).cast("string"))
    return rows.withColumn("split", known).withColumn("subject", F.coalesce("subject", missing))


def load_parquet(
    spark: SparkSession, name: str, root: str, key: str, sizes: Mapping[str, int] | None = None, mode: str = "all"
) -> DataFrame:
    """A staged parquet data set, numbered per split and standardized.

    Every split of the registry must be there.  Files have no order, so ``key``
    says what the positions follow.
    """
    entry = resolve(name)
    if entry.layout != "parquet":
        raise ValueError(f"{name} is not staged as parquet")
    raw = scan_splits(spark, {s: [f"{root}/{name}/{s}"] for s in entry.splits}, sizes).withColumn("dataset", F.lit(name))
    rows = standardize.STANDARDIZERS[name](source_position(raw, ["source_split"], key))
    required = quality.REQUIRED_SPLITS.get(name, quality.DEFAULT_SPLITS)
    wanted = spark.createDataFrame([(name, s) for s in required], "dataset string, split string")
    mapped = map_splits(rows, mode)
    quality.enforce(quality.required_splits(mapped, wanted), "required split")
    return mapped


def load_examples(
    spark: SparkSession, name: str, root: str, seed: int, test: float | None = None, validation: float | None = None
) -> DataFrame:
    """A data set of category files, cut into splits per category and standardized.

    All categories must be there.  Without ratios the published split sizes are
    cut if there are rows enough, else a quarter and a tenth of each category.
    """
    wanted = spark.createDataFrame([(c,) for c in standardize.BBH_CATEGORIES], "subject string")
    rows = scan_examples(spark, f"{root}/{name}", wanted)
    keyed = rows.withColumn("__key", F.concat_ws("/", "subject", "source_index")).drop("source_index")
    published = standardize.BBH_TEST_ROWS + standardize.BBH_VALIDATION_ROWS
    exact = test is None and validation is None and rows.count() >= published
    if exact:
        cut = split_stratified(keyed, "__key", seed, "subject", standardize.BBH_TEST_ROWS, standardize.BBH_VALIDATION_ROWS, True)
    else:
        cut = split_stratified(keyed, "__key", seed, "subject", 0.25 if test is None else test, 0.10 if validation is None else validation)
    return standardize.STANDARDIZERS[name](cut).withColumn("split", F.col("source_split"))


def load_dataset(
    spark: SparkSession, name: str, root: str, key: str, seed: int = 42, load_mode: str = "by_subject",
    test: float | None = None, validation: float | None = None, sampling: DataFrame | None = None,
    sizes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Any registered data set below ``root``: scanned, checked, standardized, sampled.

    ``load_mode`` names missing subjects (mmlu); ``test`` and ``validation`` are
    split ratios of category files; ``sampling`` has a strategy, size and seed
    offset per split.  ``sizes`` are expected rows per source split; for arc the
    published ones hold unless others are given.
    """
    if resolve(name).layout == "examples":
        rows = load_examples(spark, name, root, seed, test, validation)
    else:
        expected = ARC_SPLIT_SIZES if name == "arc" and sizes is None else sizes
        rows = load_parquet(spark, name, root, key, expected, load_mode if name == "mmlu" else "all")
    return rows if sampling is None else sample_bundle(rows, sampling, "source_index", "split", seed)
