"""Report and log sinks as tidy tables, and the data behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtide.functions.scalar import duration_text, report_round, utc_timestamp
from seqtide.operators.ordered import Seq
from seqtide.plans.profiles import session_summary

REPORT_COLUMNS = ("test", "section", "grp", "n", "stat", "p", "verdict")


def report_rows(df: DataFrame, test: str, n: str, stat: str, p: str | None = None, section: Column | None = None, grp: Column | None = None) -> DataFrame:
    """Any test result in the common report schema."""
    pv = F.col(p).cast("double") if p else F.lit(None).cast("double")
    verdict = F.when(pv < 0.05, "significant").when(pv.isNotNull(), "not significant")
    return df.select(
        F.lit(test).alias("test"),
        (section if section is not None else F.lit("")).cast("string").alias("section"),
        (grp if grp is not None else F.lit("")).cast("string").alias("grp"),
        F.col(n).cast("long").alias("n"),
        F.col(stat).cast("double").alias("stat"),
        pv.alias("p"),
        verdict.alias("verdict"),
    )


def write_report(df: DataFrame, path: str, run: str, form: str = "parquet") -> None:
    """Report rows of one run, a directory per run and test; those of the same run and test are replaced, so a run that is
    repeated leaves one copy."""
    rows = df.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "test").format(form).save(path)


# The metric lines of a session and of all sessions: label, column, digits, scale, end.
SESSION_METRICS = (
    ("Win rate", "win_rate", 1, 100, "%"), ("Metric", "avg_metric", 1, 1, "%"), ("Metric sd", "sd_metric", 1, 1, "%"), ("Metric2", "avg_metric2", 1, 1, "%"),
    ("Metric2 sd", "sd_metric2", 1, 1, "%"), ("Level", "avg_level", 2, 1, ""), ("Extreme", "n_extreme", 0, 1, ""), ("Wins when low", "win_when_low", 1, 100, "%"),
    ("Losses when high", "loss_when_high", 1, 100, "%"),
)
GLOBAL_METRICS = (("Events", "n_valid", 2, 1, ""), *[(name, column, 2 if name in ("Level", "Extreme") else 1, scale, end) for name, column, _, scale, end in SESSION_METRICS])


def metric_line(label: str, value: Column, digits: int, scale: int, end: str) -> Column:
    number = F.format_string(f"%.{digits}f", report_round((value * scale).cast("double"), digits))
    return F.concat(F.lit(f"{label}: "), number, F.lit(end))


def session_log(seq: Seq) -> DataFrame:
    """The text log of each entity: a line per event, after each session its metrics and its stop, at the end the means of
    the metrics over all sessions.

    Order inside the entity: session_no (null: all sessions), after (the event's number; null: after the events), line_no.
    Events, sessions and the whole entity are three levels of one timeline, grouped within its own exchange.
    """
    sign = F.when(F.col("variation") >= 0, "+").otherwise("")
    rating = F.when(
        F.col("rating_after").isNotNull(),
        F.concat(F.lit(" | "), F.col("rating_before").cast("string"), F.lit(" -> "), F.col("rating_after").cast("string"), F.lit(" ("), sign, F.col("variation").cast("string"), F.lit(")")),
    ).otherwise("")
    metric = F.when(F.col("metric").isNotNull(), F.format_string(" | M: %.1f%%", report_round(F.col("metric"), 1))).otherwise(" | M: null")
    second = F.when(F.col("metric2").isNotNull(), F.format_string(" (M2: %.1f%%)", "metric2")).otherwise("")
    level = F.when(F.col("level").isNotNull(), F.format_string(" - Lvl: %.1f", "level")).otherwise("")
    event = F.concat(
        F.lit("["), F.date_format(utc_timestamp("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("mode"), F.lit(" vs "), F.col("opponent").cast("string"),
        F.lit(" | "), F.when(F.col("win") == 1, "WIN").otherwise("LOSE"), F.lit(" -> "), F.col("score_for").cast("string"), F.lit("-"), F.col("score_against").cast("string"),
        rating, metric, second, level,
    )
    events = seq.df.select(*seq.keys, "session_no", F.col("rn").alias("after"), F.lit(0).alias("line_no"), event.alias("line"))
    summary = session_summary(seq)
    own = [F.concat(F.lit("Events: "), F.col("n_valid").cast("string")), *[metric_line(name, F.col(c), d, k, end) for name, c, d, k, end in SESSION_METRICS]]
    stop = F.when(F.col("stop_type") != "End", F.concat(F.lit("[STOP: "), F.col("stop_type"), F.lit(" ("), duration_text("break_s"), F.lit(")]")))
    means = summary.groupBy(*seq.keys).agg(F.count(F.lit(1)).alias("sessions"), *[F.avg(c).alias(c) for _, c, _, _, _ in GLOBAL_METRICS])
    every = [F.concat(F.lit("All sessions: "), F.col("sessions").cast("string")), *[metric_line(name, F.col(c), d, k, end) for name, c, d, k, end in GLOBAL_METRICS]]

    def lines(df: DataFrame, session: Column, texts: list[Column]) -> DataFrame:
        long = df.select(*seq.keys, session.cast("long").alias("session_no"), F.lit(None).cast("long").alias("after"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
        return long.withColumn("line_no", F.col("line_no") + 1).filter("line is not null")

    return events.unionByName(lines(summary, F.col("session_no"), [*own, stop])).unionByName(lines(means, F.lit(None), every))


def write_session_log(log: DataFrame, path: str, run: str, partitions: int = 64) -> None:
    """The log of one run in ``partitions`` files' worth of entities, in reading order; the same run is replaced."""
    place = [F.col("session_no").asc_nulls_last(), F.col("after").asc_nulls_last(), "line_no"]
    bucket = F.pmod(F.xxhash64("entity"), F.lit(partitions))
    spread = log.withColumn("entity_bucket", bucket).withColumn("run", F.lit(run)).repartitionByRange("entity_bucket", "entity", *place)
    spread.sortWithinPartitions("entity_bucket", "entity", *place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "entity_bucket").parquet(path)


def chart_points(seq: Seq) -> DataFrame:
    """Chart data: number of each event with a metric, its colour, and stop markers between.

    A marker sits half a step after the last numbered event of the session.
    """
    s = seq.running({"seq_no": ("sum", F.col("metric").isNotNull().cast("long"))})
    point = F.when(
        F.col("metric").isNotNull(),
        F.struct(F.col("seq_no").cast("double").alias("x"), F.col("metric").alias("y"), F.when(F.col("win") == 1, "green").otherwise("red").alias("mark")),
    )
    stop = F.when(
        F.col("is_last") & (F.col("stop_type") != "End") & (F.col("seq_no") > 0),
        F.struct((F.col("seq_no") + 0.5).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("stop_type").alias("mark")),
    )
    return s.df.select(*seq.keys, F.explode(F.array_compact(F.array(point, stop))).alias("p")).select(*seq.keys, "p.*")
