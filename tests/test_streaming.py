"""Streams over landed files: equal to the batch result, idempotent, late rows kept aside."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqtide.schemas import EVENTS
from seqtide.streaming import fold, jobs
from seqtide.streaming import versioned as vt

SCHEMA = "entity long, event_id long, ts long, win int, metric double"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/landed/{name}")


def stream(spark, folder, files=1):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.read_landed(spark, f"{folder}/landed/*", schema, files_per_batch=files)


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    day = 86400
    land(spark, tmp_path, "a", [(1, 1, 10 * day, 1, 1.0), (1, 2, 10 * day + 5, 0, 1.0), (1, 2, 10 * day + 5, 0, 1.0)])
    schema = spark.createDataFrame([], SCHEMA).schema
    target, late = f"{tmp_path}/events", f"{tmp_path}/late"
    sink = jobs.intake_sink(target, late, "entity", schema)
    jobs.start(stream(spark, tmp_path), sink, f"{tmp_path}/cp").awaitTermination()
    land(spark, tmp_path, "b", [(1, 3, 8 * day, 1, 1.0), (1, 1, 10 * day, 1, 1.0), (1, 4, 10 * day + 60, 1, 1.0), (2, 5, 8 * day, 1, 1.0)])
    jobs.start(stream(spark, tmp_path), sink, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 4, 5]
    assert [r["event_id"] for r in spark.read.parquet(late).collect()] == [3]
    # Any batch once more changes nothing, in the target or on the side.
    for epoch, name in ((1, "b"), (0, "a"), (1, "b")):
        sink(spark.read.parquet(f"{tmp_path}/landed/{name}"), epoch)
        assert sorted(r["event_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 4, 5]
        assert [r["event_id"] for r in spark.read.parquet(late).collect()] == [3]


def test_an_empty_batch_is_stored_as_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    sink = jobs.intake_sink(f"{tmp_path}/events", f"{tmp_path}/late", "entity", schema)
    sink(spark.createDataFrame([], schema), 0)
    sink(spark.createDataFrame([(1, 1, 5, 1, 1.0)], schema), 1)
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/events").collect()] == [1]


def fold_rows(folder, rows, parts, spark, end, **how):
    """Rows landed in ``parts`` files, read a file a batch, then a closing row."""
    size = -(-len(rows) // parts)
    for p in range(parts):
        land(spark, folder, f"p{p}", rows[p * size : (p + 1) * size])
    land(spark, folder, "z", [(-1, None, end, None, None)])
    q = jobs.start(fold.entity_states(stream(spark, folder), **how), jobs.epoch_sink(f"{folder}/out"), f"{folder}/cp")
    q.awaitTermination()
    return sorted((r["entity"], r["ts"], -1 if r["event_id"] is None else r["event_id"], r["streak"], r["stress"], r["best"], r["alert"]) for r in spark.read.parquet(f"{folder}/out").collect()), q


def folded_by_hand(rows, gap, alert_at):
    out = []
    for e in sorted({r[0] for r in rows}):
        last, wins, losses, stress, best = None, 0, 0, 0.0, None
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1]))
        for k, (_, i, ts, win, m) in enumerate(mine):
            if last is not None and ts - last >= gap:
                wins, losses, stress = 0, 0, 0.0
            wins, losses = (wins + 1, 0) if win else (0, losses + 1)
            stress = max(0.0, stress - 2.0 * wins) if win else stress + 1 + 0.5 * (m is not None and m < 45) + 0.5 * (m is not None and m < 35)
            best = best if m is None else m if best is None else max(best, m)
            last, risk = ts, losses >= 2 and stress >= alert_at
            out.append((e, ts, i, wins or -losses, stress, best, "quit risk" if risk else ""))
            if risk and (k + 1 == len(mine) or mine[k + 1][2] - ts >= gap):
                out.append((e, ts + gap, -1, -losses, stress, best, "quit"))
    return sorted(out)


def test_fold_is_the_same_however_rows_arrive(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1 + i % 3, i, i * 400 + rng.randint(0, 3000), rng.randint(0, 1), None if i % 9 == 0 else float(i * 13 % 90)) for i in range(60)]
    want = folded_by_hand(rows, 1200, 3.0)
    assert any(r[6] == "quit" for r in want)
    near = sorted(rows, key=lambda r: r[2] + rng.randint(0, 3000))  # out of order within the delay
    for name, parts, order in (("one", 1, rows), ("many", 4, near)):
        got, _ = fold_rows(tmp_path / name, order, parts, spark, 10**6, idle_s=10**5, delay="1 hour")
        assert got == want


def test_an_idle_entity_is_dropped_from_the_state(spark, tmp_path):
    rows = [(e, e, 100 + e, 0, 1.0) for e in range(1, 6)]
    _, q = fold_rows(tmp_path / "idle", rows, 1, spark, 10**6, idle_s=5000, delay="1 minute")
    kept = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    assert max(kept) >= 5
    got, _ = fold_rows(tmp_path / "back", [*rows, (1, 9, 50_000, 1, None)], 2, spark, 10**6, idle_s=5000, delay="1 minute")
    back = [r for r in got if r[2] == 9]
    assert back == [(1, 50_000, 9, 1, 0.0, None, "")]  # its best value was forgotten


def test_windows_close_behind_the_watermark(spark, tmp_path):
    day = 86400
    for k in range(3):
        land(spark, tmp_path, f"d{k}", [(1, 10 * k + i, k * 3 * day + i * 100, 1, 1.0) for i in range(5)])
    land(spark, tmp_path, "old", [(1, 99, 50, 1, 1.0)])
    land(spark, tmp_path, "z", [(-1, None, 40 * day, None, None)])
    q = jobs.start(jobs.sessions(stream(spark, tmp_path), 1200), jobs.epoch_sink(f"{tmp_path}/out"), f"{tmp_path}/cp")
    q.awaitTermination()
    got = sorted((r["entity"], r["events"], r["first_ts"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 5, 0), (1, 5, 3 * day), (1, 5, 6 * day)]
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 1  # the closing row's own


VERSIONED = "entity long, ts long, v int, w int"


def contents(table, spark):
    return sorted(tuple(r) for r in table.read(spark).collect())


def test_versions_survive_repeated_and_half_finished_batches(spark, tmp_path):
    schema = spark.createDataFrame([], VERSIONED).schema
    table = vt.Versioned(f"{tmp_path}/t", ("entity",), schema, 4)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert contents(table, spark) == []
    whole, part = vt.replace_rows(["entity"], ["ts"]), vt.set_columns(["entity"], ["w", "ts"], ["ts"])
    assert table.apply(frame([(i, 1, i, i) for i in range(20)]), whole, "a", 0)
    assert table.apply(frame([(3, 2, 99, 0), (3, 1, 98, 0), (50, 1, 7, 7)]), whole, "a", 1)
    after = contents(table, spark)
    assert len(after) == 21 and (3, 2, 99, 0) in after and (50, 1, 7, 7) in after
    assert not table.apply(frame([(3, 9, 0, 0)]), whole, "a", 1) and not table.apply(frame([(4, 9, 0, 0)]), whole, "a", 0)
    assert contents(table, spark) == after
    # A batch that ends between its files and its manifest: its files don't count, and its next run writes them anew.
    lost = Path(f"{tmp_path}/t/data/version=3/bucket=0")
    lost.mkdir(parents=True)
    frame([(777, 1, 1, 1)]).coalesce(1).write.mode("overwrite").parquet(str(lost))
    Path(f"{tmp_path}/t/manifest/version=3").mkdir()
    assert contents(table, spark) == after
    assert table.apply(frame([(3, 5, 0, 44), (60, 5, 0, 45)]), part, "b", 0)
    now = contents(table, spark)
    assert (3, 5, 99, 44) in now and (60, 5, None, 45) in now and len(now) == 22 and not any(r[0] == 777 for r in now)
    assert table.newest(spark) == 3 and sorted(tuple(r) for r in table.read(spark, at=2).collect()) == after
    assert table.drop_superseded(spark, keep=1) > 0 and contents(table, spark) == now


def test_counts_add_up_once(spark, tmp_path):
    schema = spark.createDataFrame([], "entity long, n long, wins long, share double").schema
    table = vt.Versioned(f"{tmp_path}/m", ("entity",), schema, 4)
    merge = vt.add_counts(["entity"], {"n": "1", "wins": "v"}, ("share", "wins", "n"))
    for epoch in (0, 1, 1, 0, 2):
        table.sink(merge)(spark.createDataFrame([(1, epoch % 2), (epoch, 0)], "entity long, v int"), epoch)
    assert contents(table, spark) == [(0, 1, 0, 0.0), (1, 4, 1, 0.25), (2, 1, 0, 0.0)]


def test_event_schema_is_explicit():
    assert EVENTS["ts"].dataType.typeName() == "long"


@pytest.mark.parametrize("gap, want", [(1200, 2), (1201, 1)])
def test_session_window_splits_at_the_gap(spark, tmp_path, gap, want):
    land(spark, tmp_path, "a", [(1, i, t, 1, 1.0) for i, t in enumerate((0, 1199, 2399, 3598))])
    out = f"{tmp_path}/out"
    land(spark, tmp_path, "z", [(-1, None, 10**6, None, None)])
    jobs.start(jobs.sessions(stream(spark, tmp_path), gap), jobs.epoch_sink(out), f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(out).filter(F.col("events") > 0).count() == want
