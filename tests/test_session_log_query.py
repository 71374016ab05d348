"""The log that is written twice is made once."""

from pyspark.sql import functions as F

from checks import load_all, q_tables, registry


def test_the_log_is_made_once(spark, monkeypatch):
    load_all()
    made = spark.sparkContext.accumulator(0)

    def line(_):
        made.add(1)
        return "text"

    log = spark.range(6).select((F.col("id") % 2).alias("entity"), F.col("id").alias("session_no"), F.lit(None).cast("long").alias("after"), F.lit(1).alias("line_no"), F.udf(line, "string")("id").alias("line"))
    monkeypatch.setattr(q_tables.tl, "timeline", lambda spark, sf: None)
    monkeypatch.setattr(q_tables.rp, "session_log", lambda seq: log)
    assert registry.QUERIES["s20_f04_session_log"](spark, "").select("session_no", "line", "run").orderBy("session_no").collect() == [(k, "text", "r1") for k in range(6)]
    assert made.value == 6
