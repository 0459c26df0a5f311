"""Advisor gate: context texts, decision keys, lookup and veto."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.operators.resample import SERIES


def bar_lines(steps: DataFrame, last: int = 30) -> DataFrame:
    """Each step's last visible bars as lines, oldest first; the bar of the step itself is marked while it forms.

    ``steps`` are forming rows: the bars before are the closed ones of the series.
    """
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "), F.concat_ws(",", *[F.format_string("%.4f", F.col(c)) for c in ("open", "high", "low", "close")]), F.lit(" "), F.col("volume").cast("long").cast("string")
    )
    s = steps.withColumn("w_line", line)
    closed = s.groupBy(*SERIES, "bar_no").agg(F.max_by("w_line", "step").alias("w_line"))
    w = Window.partitionBy(*SERIES).orderBy("bar_no").rowsBetween(-(last - 1), -1)
    before = closed.select(*SERIES, "bar_no", F.collect_list("w_line").over(w).alias("w_before"))
    now = F.concat("w_line", F.when(F.col("is_closed"), F.lit("")).otherwise(F.lit(" <forming>")))
    return s.join(before, [*SERIES, "bar_no"]).withColumn("lines", F.concat_ws("\n", F.concat("w_before", F.array(now)))).drop("w_line", "w_before")


def context(side: Column, size: Column, stop: Column, target: Column, price: Column, lines: Column, prompt: Column) -> Column:
    """The text that an advisor would read for a candidate; reward to risk only with both levels and a risk."""
    rr = F.abs(target - price) / F.abs(price - stop)
    ratio = F.when(stop.isNotNull() & target.isNotNull() & (price != stop), F.format_string("reward:risk %.2f", rr))
    levels = F.concat_ws(" ", F.when(stop.isNotNull(), F.format_string("stop %.4f", stop)), F.when(target.isNotNull(), F.format_string("target %.4f", target)))
    return F.concat_ws("\n", prompt, F.concat_ws(" ", side, F.format_string("%.4f", size), levels), ratio, lines)


def decision_key(*texts: Column) -> Column:
    """SHA-256 of the JSON list of the texts, with ", " between them and every character beyond ASCII escaped."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[_quoted(t) for t in texts]), F.lit("]")).cast("binary"), 256)


def _quoted(t: Column) -> Column:
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        t = F.replace(t, F.lit(raw), F.lit(name))

    def shown(c: Column) -> Column:
        p = F.ascii(c)  # the code point
        unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        pair = F.concat(unit(F.lit(0xD800) + F.floor((p - 0x10000) / 1024)), unit(F.lit(0xDC00) + (p - 0x10000) % 1024))
        return F.when((p >= 32) & (p < 127), c).when(p < 0x10000, unit(p)).otherwise(pair)

    escaped = F.array_join(F.transform(F.split(t, ""), shown), "")
    return F.concat(F.lit('"'), F.when(F.regexp_like(t, F.lit("[^ -~]")), escaped).otherwise(t), F.lit('"'))


def lookup(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with their stored decision (null: none yet), and the distinct keys that need a call."""
    once = decisions.dropDuplicates(["key"])
    return candidates.join(once, "key", "left"), candidates.select("key").distinct().join(once, "key", "left_anti")


def not_vetoed(decided: DataFrame, missing_is_approved: bool = True) -> DataFrame:
    return decided.where(F.coalesce("approved", F.lit(missing_is_approved)))
