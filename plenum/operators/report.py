"""Result matrices, contrasts and comparison with reference values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.names import model_alias
from plenum.operators.audit import tolerance_violations

# ---------------------------------------------------------------------------
# Fixed values (variant and contrast tables, published accuracies)
VARIANT_SOURCES = (
    # variant, source variant, round (NULL: headline)
    ("SFT-only", "sft_only", None),
    ("SFT+Base-C", "sft_base_critic", None),
    ("SFT+Trained-C", "sft_trained_critic", None),
    ("No-SFT", "no_sft_full", None),
    ("Full-R0", "full", 0),
    ("Full-R4", "full", None),
)
CONTRASTS = (
    ("inference_interaction", "Full-R4", "Full-R0"),
    ("base_critic_interaction", "SFT+Base-C", "SFT-only"),
    ("actor_dpo_solo", "Full-R0", "SFT-only"),
    ("full_vs_sft", "Full-R4", "SFT-only"),
)
REFERENCE_VALUES = (
    # model, dataset, method, accuracy, half width of the 95% interval
    ("llama3", "boolq", "ACC-Collab", 0.887, 0.005), ("llama3", "boolq", "ACC-Collab+", 0.894, 0.003),
    ("llama3", "mmlu", "ACC-Collab", 0.644, 0.010), ("llama3", "mmlu", "ACC-Collab+", 0.683, 0.012),
    ("llama3", "bbh", "ACC-Collab", 0.593, 0.006), ("llama3", "bbh", "ACC-Collab+", 0.574, 0.003),
    ("llama3", "sciq", "ACC-Collab", 0.952, 0.000), ("llama3", "sciq", "ACC-Collab+", 0.948, 0.003),
    ("llama3", "arc", "ACC-Collab", 0.881, 0.004), ("llama3", "arc", "ACC-Collab+", 0.869, 0.002),
    ("mistral", "boolq", "ACC-Collab", 0.877, 0.002), ("mistral", "boolq", "ACC-Collab+", 0.893, 0.002),
    ("mistral", "mmlu", "ACC-Collab", 0.610, 0.005), ("mistral", "mmlu", "ACC-Collab+", 0.672, 0.004),
    ("mistral", "bbh", "ACC-Collab", 0.519, 0.009), ("mistral", "bbh", "ACC-Collab+", 0.601, 0.004),
    ("mistral", "sciq", "ACC-Collab", 0.902, 0.005), ("mistral", "sciq", "ACC-Collab+", 0.905, 0.002),
    ("mistral", "arc", "ACC-Collab", 0.843, 0.003), ("mistral", "arc", "ACC-Collab+", 0.856, 0.003),
    ("gemma2", "boolq", "ACC-Collab", 0.840, 0.005), ("gemma2", "boolq", "ACC-Collab+", 0.845, 0.005),
    ("gemma2", "mmlu", "ACC-Collab", 0.510, 0.016), ("gemma2", "mmlu", "ACC-Collab+", 0.555, 0.003),
    ("gemma2", "bbh", "ACC-Collab", 0.513, 0.006), ("gemma2", "bbh", "ACC-Collab+", 0.475, 0.008),
    ("gemma2", "sciq", "ACC-Collab", 0.918, 0.003), ("gemma2", "sciq", "ACC-Collab+", 0.909, 0.003),
    ("gemma2", "arc", "ACC-Collab", 0.852, 0.003), ("gemma2", "arc", "ACC-Collab+", 0.849, 0.002),
)
# ---------------------------------------------------------------------------


def _fixed(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def variant_accuracy(metrics: DataFrame) -> DataFrame:
    """Accuracy in points per (model, dataset, variant) from per-round metrics.

    ``metrics`` has model, dataset, source, round and accuracy.  The headline
    is the last round; two variants may read rounds of the same run.
    """
    table = _fixed(metrics.sparkSession, VARIANT_SOURCES, "variant string, source string, at_round int")
    cells = metrics.groupBy("model", "dataset", "source").agg(
        F.max_by("accuracy", "round").alias("headline"),
        F.max(F.when(F.col("round") == 0, F.col("accuracy"))).alias("first"),
    )
    value = F.when(F.col("at_round") == 0, F.col("first")).otherwise(F.col("headline"))
    return cells.join(table, "source").select("model", "dataset", "variant", (value * 100.0).alias("accuracy"))


def unknown_variants(rows: DataFrame) -> DataFrame:
    names = [v for v, _, _ in VARIANT_SOURCES]
    return rows.filter(~F.coalesce(F.col("variant").isin(*names), F.lit(False)))


def contrast_rows(accuracy: DataFrame) -> DataFrame:
    """Upper minus lower variant per contrast and cell, by two equi joins."""
    table = _fixed(accuracy.sparkSession, CONTRASTS, "contrast string, upper_variant string, lower_variant string")
    upper = accuracy.select("model", "dataset", F.col("variant").alias("upper_variant"), F.col("accuracy").alias("upper"))
    lower = accuracy.select("model", "dataset", F.col("variant").alias("lower_variant"), F.col("accuracy").alias("lower"))
    return (
        table.join(upper, "upper_variant")
        .join(lower, ["model", "dataset", "lower_variant"])
        .select("contrast", "model", "dataset", "upper", "lower", (F.col("upper") - F.col("lower")).alias("delta"))
    )


def contrast_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contrast").agg(
        F.avg("delta").alias("mean_change_points"),
        F.count_if(F.col("delta") > 0).alias("positive_cells"),
        F.count(F.lit(1)).alias("cells"),
    )


def method_delta(results: DataFrame, keys: list[str], old: str = "original", new: str = "current") -> DataFrame:
    """Current minus original accuracy; both must exist."""
    def of(method: str):
        return F.max(F.when(F.col("method") == method, F.col("accuracy")))

    wide = results.groupBy(*keys).agg(of(old).alias("original_accuracy"), of(new).alias("current_accuracy"))
    delta = F.col("current_accuracy") - F.col("original_accuracy")
    failed = F.raise_error(F.concat(F.lit("cannot compare "), F.concat_ws("/", *keys)))
    return wide.withColumn(
        "absolute_delta", F.when(delta.isNotNull(), delta).otherwise(failed)
    ).withColumn("delta_percentage_points", F.col("absolute_delta") * 100.0)


def compare_with_reference(measured: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Measured mean accuracy against published values; no match, no row.

    ``measured`` has model_type, dataset, iterations (1 or 2) and accuracy.
    """
    if reference is None:
        reference = _fixed(
            measured.sparkSession, REFERENCE_VALUES,
            "model string, dataset string, method string, paper_accuracy double, half_width double",
        )
    method = (
        F.when(F.col("iterations") == 1, "ACC-Collab")
        .when(F.col("iterations") == 2, "ACC-Collab+")
        .otherwise(F.raise_error(F.lit("iterations must be 1 or 2")))
    )
    rows = (
        measured.withColumn("model", model_alias(F.col("model_type")))
        .withColumn("dataset", F.lower(F.trim("dataset")))
        .withColumn("method", method)
        .join(reference, ["model", "dataset", "method"])
    )
    paper, got, width = F.col("paper_accuracy"), F.col("accuracy"), F.col("half_width")
    return rows.select(
        "model_type", "model", "dataset", "method", "accuracy", "paper_accuracy",
        (got - paper).alias("absolute_delta"),
        (F.try_divide(got - paper, paper) * 100.0).alias("relative_delta_percent"),
        (got > paper).alias("above_paper_mean"),
        got.between(paper - width, paper + width).alias("within_ci95"),
    )


def plan_results(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every planned cell with its result; status ok, missing or coverage."""
    joined = plan.join(results, keys, "left")
    status = (
        F.when(F.col("samples").isNull(), "missing")
        .when(F.col("samples") != F.col("expected_samples"), "coverage")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def best_role_wins(cells: DataFrame, fused: str, singles: list[str], groups: list[str]) -> DataFrame:
    """In how many cells the fused accuracy beats the best single one."""
    best = F.greatest(*singles) if len(singles) > 1 else F.col(singles[0])
    return cells.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col(fused) > best).alias("wins"),
        F.count_if(F.col(fused) == best).alias("ties"),
    )


def locked_check(locked: DataFrame, metrics: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Locked wide table against a long metrics table, both directions."""
    long = locked.unpivot(keys, columns, "metric", "accuracy")
    return tolerance_violations(metrics, long, [*keys, "metric"], "accuracy", tolerance)
