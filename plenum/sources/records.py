"""Scanning record files: JSON lines, JSON documents, CSV, gzip decisions.

Schemas are always given.  Lines are read as text and parsed with
``from_json``: the JSON reader turns a root array into several rows without a
word, the parser marks arrays, scalars and broken lines as corrupt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import strip
from plenum.operators.quality import enforce
from plenum.sources import files
from plenum.sources.files import below

# Cell texts that mean "no value".
MISSING_TOKENS = ("", "-", "--", "n/a", "na", "nan", "none", "null")
_BAD = "_corrupt_record"


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    guarded = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    record = F.from_json("value", guarded, options)
    is_object = F.substring(strip(F.col("value")), 1, 1) == "{"
    return lines.withColumn("r", record).withColumn(
        "__broken", F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull() | ~is_object
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) of all lines, blank ones included, numbered from 1 in every file.

    A file is read in byte ranges, one task each.  A first pass counts the lines of
    each range; the sum over the ranges before it, one small row a range, is added to
    a line's place inside its range.  No task reads more than its ranges.
    """
    return _numbered(_places(spark, path)).select("file", "line_no", "value")


def _places(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, the start of their byte range, and a number that rises inside the range."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"),
        F.monotonically_increasing_id().alias("__place"),
    )


def _numbered(lines: DataFrame) -> DataFrame:
    ranges = lines.groupBy("file", "__from").agg(F.count(F.lit(1)).alias("__lines"), F.min("__place").alias("__first"))
    before = Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "__from", "__first", F.coalesce(F.sum("__lines").over(before), F.lit(0)).alias("__before"))
    line_no = F.col("__before") + F.col("__place") - F.col("__first") + 1
    # the ranges are the same in both passes, as they come from one listing of the files
    return lines.join(starts, ["file", "__from"], "left").withColumn("line_no", line_no).drop("__from", "__place", "__first", "__before")


def _filled(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length(strip(F.col("value"))) > 0)


def jsonl_violations(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """(file, line_no, value) of the lines that are no JSON object of the schema."""
    return parsed_lines(_filled(numbered_lines(spark, path)), schema).filter("__broken").select("file", "line_no", "value")


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return rows.filter("not __broken")
    # the start of the line is enough for the message
    place = [F.lit(":"), F.col("line_no").cast("string")] if "line_no" in rows.columns else []
    message = F.concat(F.lit("broken line in "), F.col("file"), *place, F.lit(": "), F.substring("value", 1, 200))
    return rows.filter(F.when(F.col("__broken"), F.raise_error(message).cast("boolean")).otherwise(True))


def scan_jsonl(
    spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = True, numbered: bool = True
) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped.

    Strict: a broken line fails the job when its row is read, naming file and
    line; otherwise broken lines are left out (see ``jsonl_violations``).  The
    line number costs a pass that counts lines; without ``numbered`` the message
    names the file alone.
    """
    lines = numbered_lines(spark, path) if strict and numbered else _places(spark, path).select("file", "value")
    rows = _checked(parsed_lines(_filled(lines), schema), strict)
    return rows.select(*[F.col(f"r.{name}").alias(name) for name in schema.names])


def count_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> int:
    """Validated rows; 0 for an empty file.  A broken line is an error that names file and line."""
    counted = parsed_lines(_filled(numbered_lines(spark, path)), schema).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__broken"), F.struct("file", "line_no"))).alias("first")
    ).first()
    if counted["first"] is not None:
        raise RuntimeError(f"broken record in {counted['first']['file']}:{counted['first']['line_no']}")
    return counted["n"]


def scan_manifest_files(
    spark: SparkSession, root: str, schema: T.StructType, manifest: DataFrame, spread: int | None = None, strict: bool = True
) -> DataFrame:
    """Gzip or plain JSON-lines files named in a manifest (path below root, cell columns).

    The manifest stays a table: each listed file is opened by the task that holds
    its row, and read as a stream.  A listed file that is absent is an error, and so
    is one whose sha-256 differs, where the manifest gives it.  Broken lines fail the
    job, naming file and line, or are left out if not strict.  A file is unpacked by one
    task, as gzip cannot be split; with ``spread`` its lines are dealt out to so many
    tasks before they are parsed.  What the manifest says of a file goes with its lines.
    """
    enforce(unlisted_files(spark, root, manifest), "file is missing")
    if "sha256" in manifest.columns:
        given = manifest.select("path", F.col("sha256").alias("given")).filter("given is not null")
        wrong = files.digests(given, root).join(given, "path").filter("sha256 <> given")
        enforce(wrong.select("path"), "hash differs")
    more = [c for c in manifest.columns if c not in ("path", "sha256")]
    listed = F.struct(F.lit(True).alias("__listed"), *more)  # a file may be listed more than once
    lines = files.stream_lines(manifest.groupBy("path").agg(F.collect_list(listed).alias("__cells")), root)
    lines = lines.repartition(spread) if spread else lines
    rows = _checked(parsed_lines(_filled(lines.withColumn("file", F.col("path"))), schema), strict)
    located = rows.select("path", *[F.col(f"r.{name}").alias(name) for name in schema.names], F.explode("__cells").alias("__cell"))
    return located.select("path", *schema.names, *[F.col("__cell")[c].alias(c) for c in more])


def file_hashes(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, sha256) of files below root, read as streams on the executors."""
    return files.digests(spark.createDataFrame([(p,) for p in paths], "path string"), root).select("path", "sha256")


def unlisted_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Manifest entries without a file; files are listed, not read."""
    return manifest.join(files.listing(spark, root).select("path"), "path", "left_anti")


def scan_documents(
    spark: SparkSession, path: str | list[str], schema: T.StructType, path_columns: dict[str, str] | None = None
) -> DataFrame:
    """One JSON object per file; path columns come from patterns on the path.

    A file whose root is no object fails the job when it is read.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    whole = text.select("value", F.col("_metadata.file_path").alias("file"))
    rows = parsed_lines(whole, schema)
    message = F.concat(F.lit("no JSON object: "), F.col("file"))
    good = rows.filter(F.when(F.col("__broken"), F.raise_error(message).cast("boolean")).otherwise(True))
    extra = [
        F.regexp_extract("file", pattern, 1).alias(name) for name, pattern in (path_columns or {}).items()
    ]
    return good.select(*extra, "r.*").drop(_BAD)


def _missing(column: str) -> Column:
    value = F.col(f"`{column}`")
    return value.isNull() | F.lower(strip(value)).isin(*MISSING_TOKENS)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text: a missing token must stay visible."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", "false").option(
        "nullValue", "\u0000"
    ).csv(path)


def missing_cells(rows: DataFrame) -> DataFrame:
    """One row per missing cell: the column and the row as JSON."""
    found = F.array_compact(F.array(*[F.when(_missing(c), F.lit(c)) for c in rows.columns]))
    return rows.select(F.explode(found).alias("column"), F.to_json(F.struct("*")).alias("row"))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV without missing cells, cast to the schema; the one pass fails at a missing cell."""
    rows = read_csv_text(spark, path, schema.names)
    lacking = F.array_compact(F.array(*[F.when(_missing(c), F.lit(c)) for c in rows.columns]))
    message = F.concat(F.lit(f"missing value in {path}: "), F.array_join(lacking, ", "))
    rows = rows.filter(F.when(F.size(lacking) > 0, F.raise_error(message).cast("boolean")).otherwise(True))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
