"""Counts, accuracy and timing over findings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finding_counts(findings: DataFrame) -> DataFrame:
    """(dimension, value, findings): totals, and counts by severity, detector and confidence, in one pass of grouping sets."""
    rows = findings.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("severity", "detector", "confidence")])
    sets = rows.groupingSets([["severity"], ["detector"], ["confidence"], []], "severity", "detector", "confidence")
    out = sets.agg(F.count("*").alias("findings"), F.grouping("severity").alias("a"), F.grouping("detector").alias("b"), F.grouping("confidence").alias("c"))
    dimension = F.when(F.col("a") == 0, "severity").when(F.col("b") == 0, "detector").when(F.col("c") == 0, "confidence").otherwise("total")
    return out.select(dimension.alias("dimension"), F.coalesce("severity", "detector", "confidence", F.lit("")).alias("value"), "findings")


def per_file(findings: DataFrame) -> DataFrame:
    """(path, findings, worst): findings of each file and the rank of the worst."""
    from solstrata.operators.rules import severity_rank

    return findings.groupBy("path").agg(F.count("*").alias("findings"), F.max(severity_rank(F.col("severity"))).alias("worst"))


def accuracy(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(detector, true_positives, false_positives, false_negatives, precision, recall, f1); keys say when two rows are one.

    Rows are matched one to one: the k-th of equal rows on one side with the k-th on the other.
    """
    w = Window.partitionBy("detector", *keys).orderBy(F.lit(0))
    number = lambda df, flag: df.select("detector", *keys, F.row_number().over(w).alias("k"), F.lit(1).alias(flag))
    both = number(found, "f").join(number(expected, "e"), ["detector", *keys, "k"], "full")
    out = both.groupBy("detector").agg(F.count_if(F.expr("f = 1 and e = 1")).alias("true_positives"), F.count_if(F.expr("e is null")).alias("false_positives"), F.count_if(F.expr("f is null")).alias("false_negatives"))
    out = out.withColumn("precision", F.expr("try_divide(true_positives, true_positives + false_positives)")).withColumn("recall", F.expr("try_divide(true_positives, true_positives + false_negatives)"))
    return out.withColumn("f1", F.expr("try_divide(2 * true_positives, 2 * true_positives + false_positives + false_negatives)"))


def timing(runs: DataFrame, by: str = "detector", value: str = "seconds") -> DataFrame:
    """(by, runs, mean, min, max, stddev, share): population statistics of measured runs and the share of the total."""
    out = runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stddev"), F.sum(value).alias("total"))
    everything = F.sum("total").over(Window.partitionBy())  # one row per name, so one task holds names only
    return out.select(by, "runs", "mean", "min", "max", "stddev", (F.col("total") / everything).alias("share"))


def slowest(runs: DataFrame, n: int = 10, key: str = "path", value: str = "seconds") -> DataFrame:
    """The n slowest, ties by name; a top-k without a full sort."""
    return runs.orderBy(F.desc(value), key).limit(n)


def slowdowns(current: DataFrame, saved: DataFrame, by: str = "detector", threshold: float = 0.1, least_saved: float = 0.1, least_change: float = 0.05) -> DataFrame:
    """(by, saved, current, change) of means that grew by more than threshold, above the noise floors."""
    both = current.select(by, F.col("mean").alias("current")).join(saved.select(by, F.col("mean").alias("saved")), by)
    both = both.withColumn("change", F.expr("try_divide(current - saved, saved)"))
    return both.where((F.col("saved") >= least_saved) & (F.col("current") - F.col("saved") >= least_change) & (F.col("change") > threshold))
