"""A key cut into segments must give the rows of the plain window plan."""

import pytest
from pyspark.sql import functions as F

from seqtide.operators import sequence as sq
from seqtide.operators.ordered import ordered
from seqtide.plans import profiles as pr
from seqtide.plans import timeline as tl

RULE = tl.SessionRule(100, 300, 900)


@pytest.fixture(scope="module")
def log(spark):
    """600 events, 400 of them of entity 1, many with equal times."""
    i = F.col("id")
    return (
        spark.range(600)
        .select(
            F.when(i % 3 != 0, F.lit(1)).otherwise(2 + i % 5).alias("entity"),
            i.alias("event_id"),
            (F.floor(i / 2) * 7 + F.when(i % 50 > 40, i * 3).otherwise(0)).cast("long").alias("ts"),
            F.when(i % 7 == 0, "Other").otherwise("Ladder").alias("mode"),
            ((i * 7919 % 13) % 2).cast("int").alias("win"),
            F.when(i % 11 != 0, (i * 31 % 100).cast("double")).alias("metric"),
            F.when(i % 9 != 0, (i * 17 % 100).cast("double")).alias("metric2"),
            F.when(i % 8 != 0, (i % 21 - 10) / 10).alias("level"),
            F.when(i % 5 != 0, F.when(i % 2 == 0, 30).otherwise(-30)).cast("long").alias("change"),
            F.lit(6000).alias("current_rating"),
            (i % 6).alias("deck"),
        )
        .cache()
    )


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def both(log, make, columns, max_rows=37):
    plain, cut = (make(tl.build(log, "all", RULE, m)) for m in (None, max_rows))
    return rows(plain.df, columns), rows(cut.df, columns)


def test_sessions_and_rating(log):
    cols = ["entity", "event_id", "session_no", "pos", "n", "break_s", "stop_type", "rating_before", "rating_after"]
    plain, cut = both(log, lambda s: s, cols)
    assert plain == cut
    assert len(plain) == 600


def test_streaks_stress_counter(log):
    cols = ["entity", "event_id", "win_streak", "loss_streak", "streak_before", "stress_after", "stress_before", "counter_streak"]
    plain, cut = both(log, pr.with_state, cols)
    assert plain == cut


def test_neighbours_and_frames(log):
    def make(s):
        s = tl.with_prev(tl.with_next(s, ["metric", "win"]), ["win"], 3)
        s = sq.rolling_mean(s, "metric2", "mean20", 20, 5)
        return sq.ngrams(s, {"hi": F.col("metric") > 50}, 3)

    cols = ["entity", "event_id", "next_metric", "next_win", "prev3_win", "mean20", "is_window", "hi_all"]
    plain, cut = both(log, make, cols)
    assert plain == cut


def test_filtered_runs(log):
    def make(s):
        valid = s.filter("metric IS NOT NULL").with_columns({"state": F.floor(F.col("metric") / 40)})
        return sq.runs(valid, "state")

    plain, cut = both(log, make, ["entity", "event_id", "run_no", "run_start"])
    assert plain == cut


def test_profile_is_the_same(log):
    plain, cut = (pr.behaviour_profile(pr.with_state(tl.build(log, "all", RULE, m))) for m in (None, 37))
    assert rows(plain, plain.columns) == rows(cut, plain.columns)


def test_no_task_gets_more_than_a_segment(log):
    seq = ordered(log, "entity", ["ts", "event_id"], max_rows=37)
    assert seq.split
    largest = seq.df.groupBy("entity", "__seg").count().agg(F.max("count")).first()[0]
    small = log.groupBy("entity").count().filter("count <= 37").agg(F.max("count")).first()[0] or 0
    assert largest <= max(37, small)


def test_attempts_and_best(log):
    def make(s):
        return sq.attempts(sq.running_best(s, "metric"), F.col("metric") > 60)

    plain, cut = both(log, make, ["entity", "event_id", "best", "attempt"])
    assert plain == cut


def test_a_written_timeline_needs_no_exchange(spark, tmp_path):
    from pyspark.sql import Window

    from seqtide.plans import timeline as tl

    rows = [(1 + i % 5, i, i * 60, "Ladder", i % 2, 30, 6000) for i in range(100)]
    log = spark.createDataFrame(rows, "entity long, event_id long, ts long, mode string, win int, change long, current_rating long")
    seq = tl.build(log)
    written = tl.materialize(seq, "written_timeline_test", str(tmp_path / "timeline"), 4)
    assert sorted(map(tuple, written.frame.select(*seq.columns).collect())) == sorted(map(tuple, seq.frame.select(*seq.columns).collect()))
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    plan = written.frame.withColumn("k", F.row_number().over(w))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" not in plan
    spark.sql("DROP TABLE written_timeline_test")


def test_a_frame_may_reach_over_several_segments(spark):
    log = spark.range(100).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    total = lambda w: F.sum("v").over(w.rowsBetween(-25, 12))
    whole = ordered(log, "k", ["id"]).near({"s": total}, back=25, ahead=12).frame
    cut = ordered(log, "k", ["id"], max_rows=10).near({"s": total}, back=25, ahead=12).frame
    assert sorted(map(tuple, whole.select("id", "s").collect())) == sorted(map(tuple, cut.select("id", "s").collect()))
