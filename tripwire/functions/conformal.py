"""Conformal prediction sets over class probabilities p, an array in the order of the classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators.ranks import order_statistics


def class_array(classes: list[str]) -> Column:
    return F.array(*map(F.lit, classes))


def p_of(truth: Column, classes: list[str] | None = None) -> Column:
    return F.element_at("p", F.array_position(class_array(classes or C.CLASSES), truth).cast("int"))


def argmax_class(classes: list[str] | None = None) -> Column:
    """The class of the first largest probability."""
    return F.element_at(class_array(classes or C.CLASSES), F.array_position("p", F.array_max("p")).cast("int"))


def qhat(calibration: DataFrame, alpha: float = C.ALPHA, truth: str = "y") -> float:
    """The calibrated threshold: of the scores 1 - p(truth) in order, the one at index min(ceil((n+1)(1-alpha)), n-1)."""
    scores = calibration.select((1 - p_of(F.col(truth))).alias("score"))
    index = lambda n: min(math.ceil((n + 1) * (1 - alpha)), n - 1)
    n, at = order_statistics(scores, "score", lambda n: [index(n)])
    if not n:
        raise ValueError("no calibration rows")
    return at[index(n)]


def prediction_set(q: float | Column, classes: list[str] | None = None) -> Column:
    """The classes whose probability is at least 1 - q, sorted; may be empty."""
    limit = 1 - (F.lit(q) if isinstance(q, float) else q)
    kept = F.filter(F.arrays_zip(class_array(classes or C.CLASSES).alias("c"), F.col("p")), lambda x: x["p"] >= limit)
    return F.array_sort(F.transform(kept, lambda x: x["c"]))


def naive_set(alpha: float = C.ALPHA) -> Column:
    """The most likely class, and all with probability of at least 1 - alpha."""
    return F.array_sort(F.array_union(F.array(argmax_class()), prediction_set(alpha)))


def coverage(sets: DataFrame, set_: str = "set", truth: str = "y") -> DataFrame:
    size = F.size(set_)
    share = lambda c: F.avg(c.cast("double"))
    return sets.agg(share(F.array_contains(set_, F.col(truth))).alias("coverage"), F.avg(size).alias("mean_size"), share(size == 1).alias("singleton"), share(size > 1).alias("ambiguous"), share(size == 0).alias("empty"))


def routing(sets: DataFrame, set_: str = "set") -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return sets.agg(share(F.size(set_) == 1).alias("act_singleton"), share(F.size(set_) > 1).alias("escalate_ambiguous"), share(F.size(set_) == 0).alias("escalate_empty"))


def action(set_: str = "set") -> Column:
    return F.when(F.size(set_) != 1, "escalate").otherwise("act")


def reason(set_: str = "set", incident: str = "prediction") -> Column:
    return F.when(F.size(set_) != 1, F.concat(F.lit("ambiguous set ["), F.array_join(set_, ", "), F.lit("]"))).otherwise(F.concat(F.lit("confident "), F.col(incident)))


def hedged_share(sets: DataFrame, incident: str, both: list[str], set_: str = "set", truth: str = "y") -> DataFrame:
    """The share of a class whose set holds all of ``both``."""
    return sets.filter(F.col(truth) == incident).agg(F.avg((F.size(F.array_except(class_array(both), set_)) == 0).cast("double")).alias("hedged"))


def misread_confidence(scored: DataFrame, truth: str, read_as: str) -> DataFrame:
    """Mean probabilities of the wrong and the right class where the first was predicted for the second."""
    return scored.filter((F.col("y") == truth) & (F.col("prediction") == read_as)).agg(F.avg(p_of(F.lit(read_as))).alias("p_wrong"), F.avg(p_of(F.lit(truth))).alias("p_right"), F.count("*").alias("n"))
