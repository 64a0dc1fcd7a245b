"""Classifier metrics from a table of true and predicted labels.

Everything starts from the confusion counts, at most K x K rows for K labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBABILITY_FLOOR = 1e-15


def class_weights(
    train: DataFrame, label: str, labels: list, weight: str = "weight"
) -> DataFrame:
    """rows / (labels * rows of the label); null for a label without rows."""
    known = train.where(F.col(label).isin(labels))
    counts = known.groupBy(label).agg(F.count("*").alias("n"))
    listed = train.sparkSession.createDataFrame([(x,) for x in labels], [label]).select(
        F.col(label).cast(train.schema[label].dataType).alias(label),
        F.lit(None).cast("long").alias("n"),
    )
    full = counts.unionByName(listed).groupBy(label).agg(F.sum("n").alias("n"))
    total = full.agg(F.sum("n")).scalar()
    return full.select(
        label,
        F.coalesce("n", F.lit(0)).alias("n"),
        (total / (F.lit(len(labels)) * F.col("n"))).alias(weight),
    )


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: list, y: str = "y", p: str = "p") -> DataFrame:
    """One row per true label, one ``p_<label>`` column per predicted label, zero filled."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("p") == F.lit(x), F.col("n"))), F.lit(0))
        .cast("long")
        .alias(f"p_{x}")
        for x in labels
    ]
    blank = df.sparkSession.createDataFrame([(x,) for x in labels], ["y"]).select(
        F.col("y").cast(df.schema[y].dataType).alias("y"),
        F.lit(None).cast(df.schema[p].dataType).alias("p"),
        F.lit(0).cast("long").alias("n"),
    )
    return confusion_counts(df, y, p).unionByName(blank).groupBy("y").agg(*cells)


def class_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per label; a zero denominator gives 0."""
    counts = confusion_counts(df, y, p)
    as_true = counts.select(
        F.col("y").alias("label"),
        F.col("n").alias("support"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    as_predicted = counts.select(
        F.col("p").alias("label"),
        F.lit(0).cast("long").alias("support"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("hit"),
    )
    sums = (
        as_true.unionByName(as_predicted)
        .groupBy("label")
        .agg(*[F.sum(c).cast("long").alias(c) for c in ("support", "predicted", "hit")])
    )
    hit = F.col("hit").cast("double")

    def share(of: Column) -> Column:
        return F.when(of == 0, F.lit(0.0)).otherwise(hit / of)

    return sums.select(
        "label",
        share(F.col("predicted")).alias("precision"),
        share(F.col("support")).alias("recall"),
        share((F.col("predicted") + F.col("support")) / 2).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """``macro`` and ``weighted`` rows under a class report."""
    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    macro = report.agg(
        F.lit("macro").alias("label"),
        *[F.avg(m).alias(m) for m in measures],
        support.alias("support"),
    )
    weighted = report.agg(
        F.lit("weighted").alias("label"),
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures],
        support.alias("support"),
    )
    return macro.unionByName(weighted)


def full_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Class rows followed by the macro and weighted averages."""
    report = class_report(df, y, p).withColumn("label", F.col("label").cast("string"))
    return report.unionByName(report_averages(report))


def weighted_f1(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return (
        report_averages(class_report(df, y, p))
        .where(F.col("label") == "weighted")
        .select(F.col("f1").alias("f1_weighted"))
    )


def log_loss(df: DataFrame, p_true: str = "p_true", weight: str | None = None) -> DataFrame:
    """Row mean of -ln(probability of the true label), weighted if asked."""
    loss = -F.log(F.greatest(F.col(p_true), F.lit(PROBABILITY_FLOOR)))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(w * loss) / F.sum(w)).alias("loss"))


def evaluation(df: DataFrame, y: str = "y", p: str = "p", p_true: str = "p_true") -> DataFrame:
    """One row: loss, accuracy and weighted F1, from one pass over the predictions.

    The per-cell sums of the loss ride along with the confusion counts.
    """
    loss = -F.log(F.greatest(F.col(p_true), F.lit(PROBABILITY_FLOOR)))
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(
        F.count("*").alias("n"), F.sum(loss).alias("loss")
    )
    hit = F.col("y") == F.col("p")
    counts = cells.select("y", "p", "n").withColumn("hit", hit)
    per_label = (
        counts.select(F.explode(F.array("y", "p")).alias("label"), "y", "n", "hit")
        .groupBy("label")
        .agg(
            # A hit cell is listed under its label twice, hence the halves.
            F.sum(F.when(F.col("hit"), F.col("n") / 2).otherwise(0)).alias("hits"),
            F.sum(
                F.when(F.col("hit"), F.col("n") / 2)
                .when(F.col("y") == F.col("label"), F.col("n"))
                .otherwise(0)
            ).alias("support"),
            F.sum("n").alias("seen"),
        )
    )
    f1 = 2 * F.col("hits") / F.col("seen")
    f1_weighted = per_label.agg(F.sum(f1 * F.col("support")) / F.sum("support")).scalar()
    return cells.agg(
        (F.sum("loss") / F.sum("n")).alias("loss"),
        (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
    ).withColumn("f1_weighted", f1_weighted)
