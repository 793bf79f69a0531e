"""Filter interaction audit: what each filter of a cleaning run removes, in every order of the filters.

A text's failures are a mask of bits, one per filter; what an order of filters does to a document depends on its mask
alone. So documents are counted into cells (part, mask), at most 2^5 a part, and each cell is folded across the array of all
orders with higher-order functions: one struct of counts for each order and step, weighted by the cell's documents. The
arrays of a part's cells are summed element by element.

Four rules look at a text alone; the last filter fails texts that equal the text of a smaller doc_id anywhere in the
table. Equal texts (by SHA-256) are counted by part, mask and labels before they meet, so a text that a third of all
documents have is a few rows.

Edge cases: a null text is the empty text; a null lang is the part ''; a null doc_id equals no smaller one and is smaller
than none; rows of one doc_id and text are each counted and don't make each other copies; repeated rows of ``labels``
count as one, with a flag that any of them has; documents without labels are neither good nor toxic; an empty table
gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
#: What a step counts, and what of a cell it counts.
COUNTED = {"kept": "n", "removed": "n", "redundant": "n", "unique_fails": "n", "good_lost": "good", "toxic_lost": "toxic"}


def rules(text: str = "text", words: str = "words") -> dict[str, Column]:
    """Conditions under which a text fails, by the filter's letter; ``words`` is the column of its words."""
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, part, digest of the text, mask of the rules, good and toxic (0 or 1)."""
    flags = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    texts = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(rules().values())), F.lit(0))
    judged = cut.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return judged.join(flags, "doc_id", "left").na.fill(0, ["good", "toxic"])


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failures, the last bit being that of copies."""
    same = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id are counted first, so that the smallest id of a group comes with its number of rows
    by_id = _labelled(documents, labels).groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.min("low").over(Window.partitionBy("digest"))  # a row for each part and labels that a text is found with
    firsts = F.col("n_null") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    copied = 1 << len(rules())
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    counted = groups.withColumn("first", first).withColumn("firsts", firsts).select("part", "good", "toxic", split.alias("cell")).filter("cell.n > 0")
    return counted.groupBy("part", "cell.mask").agg(F.sum("cell.n").alias("n"), *(F.sum(F.col("cell.n") * F.col(c)).alias(c) for c in ("good", "toxic")))


def _fold(orders: Column) -> Column:
    """A cell's counts for each order and step: an array of as many structs as orders times steps."""
    zero, mask = F.lit(0).cast("long"), F.col("mask")
    out_type = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTED) + ">>"

    def step(so_far: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, so_far["gone"]
        when = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": mask == bit, "good_lost": ~gone & fails, "toxic_lost": ~gone & fails}
        counts = F.struct(*(F.when(when[c], F.col(of)).otherwise(zero).alias(c) for c, of in COUNTED.items()))
        return F.struct((gone | fails).alias("gone"), F.concat(so_far["out"], F.array(counts)).alias("out"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(out_type).alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda x: x["out"])))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: the counts of ``COUNTED``, and the filter's Shapley sum."""
    letters = [*rules(), "E"]
    orders = ["".join(x) for x in permutations(letters)]
    bits = F.lit([[1 << letters.index(x) for x in order] for order in orders])
    added = lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTED))
    folded = cells(documents, labels).select("part", _fold(bits).alias("steps"))
    # a part has at most as many cells as there are masks
    listed = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = listed.select("part", F.aggregate(F.slice("cells", 2, 1 << len(letters)), F.col("cells")[0], lambda a, b: F.zip_with(a, b, added)).alias("steps"))
    placed = merged.select("part", F.posexplode("steps").alias("at", "counts"))
    order = F.element_at(F.lit(orders), (F.floor(F.col("at") / len(letters)) + 1).cast("int"))
    named = placed.select("part", order.alias("filter_order"), (F.col("at") % len(letters) + 1).cast("int").alias("step"), "counts.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
