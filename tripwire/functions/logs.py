"""Reading log lines: ordered patterns, explanations, groundedness, prompts and replies, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions import constants as C


def class_of(incident: Column | str) -> Column:
    """The class target: a missing or empty incident type is normal."""
    return F.coalesce(F.nullif(F.col(incident) if isinstance(incident, str) else incident, F.lit("")), F.lit(C.NORMAL))


def remedy(incident: Column, otherwise: str) -> Column:
    """The runbook's action of a class, or ``otherwise``."""
    table = F.create_map(*(F.lit(x) for pair in C.REMEDIATIONS.items() for x in pair))
    return F.coalesce(F.element_at(table, incident), F.lit(otherwise))


def fixed(x: Column, places: int) -> Column:
    """Python's fixed-point text of a number: its exact binary value, rounded half to even.

    The number is split into two halves of 26 bits, whose products with 10 ** places are exact, so a tie is seen as one.
    """
    scale, size = float(10**places), F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    whole = F.floor(size * scale).cast("double")
    over = (high * scale - whole - 0.5) + (size - high) * scale
    units = (whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)).cast("long")
    text = units.cast("string") if not places else F.concat(F.floor(units / int(scale)).cast("string"), F.lit("."), F.lpad((units % int(scale)).cast("string"), places, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def read_incident(log: Column) -> Column:
    """The class of the first pattern that occurs in the line."""
    out = F.lit(C.NORMAL)
    for incident, pattern in reversed(C.LOG_PATTERNS):
        out = F.when(F.regexp_extract(log, pattern, 0) != "", incident).otherwise(out)
    return out


def read_evidence(log: Column) -> Column:
    out = F.lit("")
    for _, pattern in reversed(C.LOG_PATTERNS):
        found = F.regexp_extract(log, pattern, 0)
        out = F.when(found != "", found).otherwise(out)
    return out


def explain(incident: Column) -> Column:
    latency = fixed(F.col("latency_ms"), 0)
    clause = F.trim(F.split_part(F.col("log"), F.lit(";"), F.lit(1)))
    read = F.concat(F.col("service"), F.lit(" shows "), clause, F.lit(" at "), latency, F.lit("ms latency."))
    return F.when(incident == C.NORMAL, F.concat(F.col("service"), F.lit(" logged a routine request at "), latency, F.lit("ms."))).otherwise(read)


def grounded(text: Column) -> Column:
    """Whether the text quotes some value of its row."""
    values = [*(fixed(F.col(m), 0) for m in ("latency_ms", "cpu_pct", "mem_pct", "rps")), fixed(F.col("error_rate"), 3), fixed(F.col("error_rate"), 2), F.col("latency_ms").cast("long").cast("string"), F.col("version")]
    return F.exists(F.array(*values), lambda v: (v != "") & F.contains(text, v))


def with_verdict(events: DataFrame) -> DataFrame:
    """``events`` with what the offline reader makes of each log line."""
    read = events.withColumn("incident", read_incident(F.col("log"))).withColumn("evidence", read_evidence(F.col("log")))
    read = read.withColumn("remediation", remedy(F.col("incident"), "none")).withColumn("explanation", explain(F.col("incident")))
    return read.withColumn("grounded", grounded(F.col("explanation"))).withColumn("reader", F.lit("offline"))


PROMPT = (
    "Service %s, second %s: latency %s ms (%s times its baseline), error rate %s, cpu %s %% (%s times its baseline), "
    "memory %s %%, %s requests a second, version %s. Log: %s. Which one is it: memory_leak, dependency_failure, "
    "traffic_spike, bad_deploy or normal? Answer as JSON with incident, evidence and explanation."
)


def prompt() -> Column:
    """A question to an external reader, from a row and its two ratios (1.0 where there are none)."""
    ratio = lambda c: fixed(F.coalesce(F.col(c), F.lit(1.0)), 1)
    return F.format_string(
        PROMPT, "service", fixed(F.col("ts"), 0), fixed(F.col("latency_ms"), 0), ratio("latency_over_baseline"), fixed(F.col("error_rate"), 3),
        fixed(F.col("cpu_pct"), 0), ratio("cpu_over_baseline"), fixed(F.col("mem_pct"), 0), fixed(F.col("rps"), 0), "version", "log",
    )


def parse_reply(replies: DataFrame, text: str = "reply") -> DataFrame:
    """``replies`` with incident, remediation, evidence, explanation and failed, from the widest braces of a reply."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), F.col(text))
    parsed = F.from_json(body, "incident string, evidence string, explanation string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = replies.withColumn("_parsed", parsed)
    failed = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    known = F.col("_parsed.incident").isin(C.CLASSES)
    rows = rows.withColumn("failed", failed).withColumn("incident", F.when(~failed & known, F.col("_parsed.incident")).otherwise(C.NORMAL))
    rows = rows.withColumn("remediation", F.when(failed, "none").otherwise(remedy(F.col("incident"), "none")))
    rows = rows.withColumn("evidence", F.when(failed, "").otherwise(F.coalesce("_parsed.evidence", F.lit(""))))
    return rows.withColumn("explanation", F.when(failed, F.concat(F.lit("unparseable reply: "), F.substring(text, 1, 80))).otherwise(F.coalesce("_parsed.explanation", F.lit("")))).drop("_parsed")


def read_with(events: DataFrame, reader: Callable[[str], str], source: str) -> DataFrame:
    """Verdicts of an external reader on rows that have a prompt column; filter to the escalated rows first.

    ``reader`` turns a prompt into a reply; an exception counts as a failure and gives a normal verdict.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("reply", T.StringType()), T.StructField("reader_error", T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for text in pdf["prompt"]:
                try:
                    replies.append(reader(text))
                    errors.append(None)
                except Exception as e:  # a reader may fail in any way
                    replies.append("")
                    errors.append(type(e).__name__)
            yield pdf.assign(reply=replies, reader_error=errors)

    return verdicts(events.mapInPandas(ask, schema), source)


def verdicts(replies: DataFrame, source: str) -> DataFrame:
    """What rows with a reply, or a reader_error in its place, amount to: incident, remediation, explanation, failed and grounded."""
    parsed = parse_reply(replies)
    why = F.when(F.col("reader_error").isNotNull(), F.concat(F.lit("reader failed: "), F.col("reader_error"))).otherwise(F.col("explanation"))
    failed = F.col("failed") | F.col("reader_error").isNotNull()
    return parsed.withColumn("explanation", why).withColumn("failed", failed).withColumn("grounded", ~failed & grounded(F.col("explanation"))).withColumn("reader", F.lit(source))


def reader_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("reader", "failed").agg(F.count("*").alias("calls"))


def resolve(scored: DataFrame, only: list[str] | None = None, prediction: str = "prediction") -> Column:
    """The class after reading the log of rows predicted to be one of ``only`` (the usual ones if empty)."""
    return F.when(F.col(prediction).isin(only or C.ESCALATED_CLASSES), read_incident(F.col("log"))).otherwise(F.col(prediction))
