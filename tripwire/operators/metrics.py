"""Evaluation reports over rows with truth y and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.functions.logs import class_of


def ground_truth(events: DataFrame) -> DataFrame:
    """Rows, breaches and share of breaches by class."""
    return events.groupBy(class_of("incident_type").alias("cls")).agg(F.count("*").alias("n"), F.sum("label").alias("breaching"), F.avg(F.col("label").cast("double")).alias("share"))


def class_report(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class in truth or prediction; 0 where undefined."""
    side = lambda c, actual: F.struct(F.col(c).alias("cls"), F.lit(actual).alias("actual"), F.lit(1 - actual).alias("predicted"))
    sides = F.array(side("y", 1), side(prediction, 0))
    hit = F.col("y") == F.col(prediction)
    counted = scored.select(hit.alias("hit"), F.explode(sides).alias("s")).groupBy("s.cls").agg(F.sum("s.actual").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("s.actual")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counted.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("cls", "precision", "recall", "f1", "support")


def macro(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    accuracy = scored.agg(F.avg((F.col("y") == F.col(prediction)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return class_report(scored, prediction).agg(F.avg("f1").alias("macro_f1")).join(F.broadcast(accuracy))


def confusion(scored: DataFrame, prediction: str = "prediction", classes: list[str] | None = None) -> DataFrame:
    classes = classes or C.CLASSES
    return scored.groupBy("y").pivot(prediction, classes).count().na.fill(0, classes)


def detection_rate(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("y").agg(F.avg(F.col("flag").cast("double")).alias("flag_rate"), F.count("*").alias("n"))


def rescue(flagged: DataFrame) -> DataFrame:
    """What the detector adds where the classifier sees nothing."""
    quiet, incident = F.col("prediction") == C.NORMAL, F.col("y") != C.NORMAL
    share = lambda when, what: F.avg(F.when(when, what.cast("double")))
    return flagged.agg(share(quiet & incident, F.col("flag")).alias("rescue_rate"), share(quiet & F.col("flag"), incident).alias("flag_precision"), share(quiet, incident).alias("base_rate"))


def layer_correlation(flagged: DataFrame) -> DataFrame:
    """Pearson correlation over incident classes of the classifier's recall and the detector's rate."""
    recall = class_report(flagged).select(F.col("cls").alias("y"), "recall")
    return detection_rate(flagged).join(recall, "y").filter(F.col("y") != C.NORMAL).agg(F.corr("recall", "flag_rate").alias("correlation"))


def class_weights(rows: DataFrame, target: str = "y") -> DataFrame:
    """n / (classes * n of the class)."""
    counts = rows.groupBy(target).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total)).select(target, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def feature_means(features: DataFrame, leaky: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean latency ratio by class, of the online and of the leaky features."""
    both = features.select("seq", F.col("latency_over_baseline").alias("online")).join(leaky.select("seq", F.col("latency_over_baseline").alias("leaky")), "seq").join(classes.select("seq", "y"), "seq")
    return both.groupBy("y").agg(F.avg("online").alias("online"), F.avg("leaky").alias("leaky"), F.count("*").alias("n"))


def feature_ranges(features: DataFrame, feature: str) -> DataFrame:
    """Range of a feature by class, and the share of rows above 1."""
    return features.groupBy("y").agg(F.min(feature).alias("low"), F.max(feature).alias("high"), F.avg((F.col(feature) > 1).cast("double")).alias("above_one"))


def latency_profile(rows: DataFrame, duration: str) -> DataFrame:
    from tripwire.operators.ranks import linear_quantiles

    p50, p95, p99 = linear_quantiles(rows, duration, [0.5, 0.95, 0.99])
    totals = rows.agg(F.max(duration).alias("max"), F.count("*").alias("n"))
    return totals.select(F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"), F.lit(p99).cast("double").alias("p99"), "max", "n")


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """Values by how often they occur, most common first, ties by value: place, value and n. Values are few."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), column)).alias("place"), column, "n").orderBy("place")


def action_spend(decided: DataFrame, action: str = "action") -> DataFrame:
    costs = decided.sparkSession.createDataFrame(list(C.COSTS.items()), f"{action} string, cost double")
    counts = decided.groupBy(action).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(costs), action).select(action, "n", (F.col("n") * F.col("cost")).alias("spend"))


def resolution_report(scored: DataFrame, resolved: str = "resolved") -> DataFrame:
    """Macro F1 and recall of dependency failures before and after reading logs, and the share of rows that were read."""
    rows = []
    for stage, column in (("before", "prediction"), ("after", resolved)):
        report = class_report(scored, column)
        rows.append(report.agg(F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("cls") == "dependency_failure", F.col("recall"))).alias("dependency_recall")).select(F.lit(stage).alias("stage"), "macro_f1", "dependency_recall"))
    read = scored.agg(F.avg(F.col("prediction").isin(C.ESCALATED_CLASSES).cast("double")).alias("read_share"))
    return rows[0].unionByName(rows[1]).join(F.broadcast(read))
