"""Binary classification metrics on any (label, score) DataFrame.

ROC-AUC and average precision are exact with ties: rows are first reduced
to one row per distinct score (positives, negatives), then running sums over
the distinct scores are computed with range buckets (``ordered.running_sums``)
so no single task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, write_once
from .ordered import range_buckets, running_sums


def score_table(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                prediction: str | None = None) -> DataFrame:
    """One pass over the scored rows: (score, predicted class) -> positives,
    negatives. Every metric below is computed from this table, which is cut
    from the input's lineage by a reliable checkpoint, so an expensive input
    (features, model scoring) is evaluated once."""
    y = F.col(label).cast("int")
    pred = F.col(prediction).cast("int") if prediction else (F.col(score) > threshold).cast("int")
    g = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
         .groupBy(F.col(score).cast("double").alias("_s"), pred.alias("_pred"))
         .agg(F.sum(y).cast("bigint").alias("_pos"), F.sum(1 - y).cast("bigint").alias("_neg")))
    return reliable_checkpoint(g)


def _ranking(g: DataFrame, digits: int) -> DataFrame:
    by_s = g.groupBy("_s").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    rs = running_sums(by_s.withColumn("_key", -F.col("_s")), "_key", ["_pos", "_neg"], inclusive=True)
    tp, fp = F.col("cum__pos"), F.col("cum__neg")
    agg = rs.agg(
        F.sum(F.col("_neg").cast("double") * ((tp - F.col("_pos")).cast("double") + 0.5 * F.col("_pos")))
        .alias("_u"),
        F.sum(F.col("_pos").cast("double") * F.try_divide(tp.cast("double"), (tp + fp).cast("double")))
        .alias("_ap"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return agg.select(
        F.round(F.try_divide(F.col("_u"), (F.col("_P") * F.col("_N")).cast("double")), digits).alias("roc_auc"),
        F.round(F.try_divide(F.col("_ap"), F.col("_P").cast("double")), digits).alias("pr_auc"))


def ranking_metrics(df: DataFrame, label: str, score: str, digits: int = 6) -> DataFrame:
    """One row: roc_auc (P(score_pos > score_neg) + 0.5 P(equal)) and
    pr_auc (average precision: sum over thresholds of recall step x
    precision at that threshold). Rows are reduced to distinct scores, then
    running sums over the scores run inside ranges (``ordered.running_sums``)."""
    return _ranking(score_table(df, label, score), digits)


def ranking_metrics_by(df: DataFrame, by: list[str], label: str, score: str, digits: int = 6) -> DataFrame:
    """``ranking_metrics`` for every group of ``by`` at once. Rows become one row
    per (group, score); ranges of scores are common to all groups, so that
    a group of any size is ranked in many tasks."""
    y = F.col(label).cast("int")
    g = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
         .groupBy(*by, (-F.col(score).cast("double")).alias("_key"))
         .agg(F.sum(y).cast("bigint").alias("_pos"), F.sum(1 - y).cast("bigint").alias("_neg")))
    t = range_buckets(write_once(g, "scores"), "_key")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offs = t.groupBy(*by, "_bucket").agg(F.sum("_pos").alias("_op"), F.sum("_neg").alias("_on")).select(
        *by, "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_op", "_on")])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(offs, [*by, "_bucket"]).withColumn("_tp", F.col("_op") + F.sum("_pos").over(inside)).withColumn("_fp", F.col("_on") + F.sum("_neg").over(inside))
    agg = t.groupBy(*by).agg(
        F.sum(F.col("_neg").cast("double") * ((F.col("_tp") - F.col("_pos")).cast("double") + 0.5 * F.col("_pos"))).alias("_u"),
        F.sum(F.col("_pos").cast("double") * F.try_divide(F.col("_tp").cast("double"), (F.col("_tp") + F.col("_fp")).cast("double"))).alias("_ap"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return agg.select(
        *by, F.round(F.try_divide(F.col("_u"), (F.col("_P") * F.col("_N")).cast("double")), digits).alias("roc_auc"),
        F.round(F.try_divide(F.col("_ap"), F.col("_P").cast("double")), digits).alias("pr_auc"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                   prediction: str | None = None, digits: int = 6, cells: bool = False) -> DataFrame:
    """One row: n, positives, roc_auc, pr_auc, accuracy, precision, recall,
    f1 (0 when undefined) and Brier score; with ``cells`` also the confusion
    counts tn, fp, fn, tp. The predicted class is
    score > threshold unless a prediction column is given."""
    g = score_table(df, label, score, threshold, prediction)
    p1 = F.col("_pred") == 1
    c = g.agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
        F.sum("_pos").cast("bigint").alias("positives"),
        F.sum(F.when(p1, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(p1, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~p1, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~p1, F.col("_neg")).otherwise(0)).alias("tn"),
        F.sum(F.col("_pos") * (F.col("_s") - 1.0) ** 2 + F.col("_neg") * F.col("_s") ** 2).alias("_sq"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))

    def z(e):
        return F.coalesce(e, F.lit(0.0))

    return c.crossJoin(_ranking(g, digits)).select(
        F.col("n").cast("bigint").alias("n"), "positives", "roc_auc", "pr_auc",
        F.round((tp + tn) / F.col("n").cast("double"), digits).alias("accuracy"),
        F.round(z(F.try_divide(tp, tp + fp)), digits).alias("precision"),
        F.round(z(F.try_divide(tp, tp + fn)), digits).alias("recall"),
        F.round(z(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)), digits).alias("f1_score"),
        F.round(F.col("_sq") / F.col("n").cast("double"), digits).alias("brier_score"),
        *(["tn", "fp", "fn", "tp"] if cells else []))


def confusion_matrix(df: DataFrame, label: str, score: str | None = None, threshold: float = 0.5,
                     prediction: str | None = None) -> DataFrame:
    """Counts of (actual, predicted) -- [[TN, FP], [FN, TP]] in long form, all
    four cells present."""
    pred = F.col(prediction).cast("int") if prediction else (F.col(score) > threshold).cast("int")
    y = F.col(label).cast("int")
    c = df.agg(*[F.count_if((y == a) & (pred == p)).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("count"))
             for a in (0, 1) for p in (0, 1)]
    return c.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def rule_score(c360: DataFrame) -> DataFrame:
    """A fixed, model-free churn score used to check the metric code against
    SQL: short tenure means risk, 1 / (1 + tenure_months / 12). It has ties
    and falls on both sides of 0.5."""
    return c360.select("account_id", F.col("churn_flag").cast("int").alias("churn_flag"),
                       (1.0 / (1.0 + F.col("tenure_months").cast("double") / 12.0)).alias("score"))
