"""Typed events of versions: batch against a loop, and a stream in several batches against one."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from marketlens.streaming import changes, events


def observed(n=300, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        fields = {k: v for k, v in (("status", rng.choice(["a", "b", None])), ("amount", rng.choice(["1", "2"])), ("x", rng.choice([None, "y"]))) if v is not None or rng.random() < 0.5}
        o = rng.randrange(12)
        rows.append((o, [*changes.EVENT_TYPES, "COMPANY", "AWARD"][o % 6], i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i + rng.randint(-60, 60)), fields or None))
    return rows


def loop(rows):
    state, out = {}, []
    for o, kind, arrival, version, fields in sorted(rows, key=lambda r: (r[2], r[3])):
        fields = fields or {}
        if o in state and version <= state[o][0]:
            continue
        new, old = o not in state, state.get(o, (None, {}))[1]
        state[o] = version, fields
        differ = sorted(k for k in {*old, *fields} if old.get(k) != fields.get(k))
        kind_of = changes._event_type(kind, new, old, fields, differ)
        if kind_of:
            said = ["status"] if kind == "COMPANY" else differ
            change = "created" if new and kind != "COMPANY" else ";".join(f"{k}={old.get(k) or 'null'}>{fields.get(k) or 'null'}" for k in said)
            out.append((o, kind, arrival, kind_of, change))
    return sorted(out)


def test_batch_equals_loop(spark):
    rows = observed()
    df = spark.createDataFrame([*rows, (None, "REQUEST", 1, dt.datetime(2024, 1, 1), {}), (1, "REQUEST", 2, None, {})], changes.OBSERVED).repartition(5)
    got = changes.batch_events(df)
    assert sorted(tuple(r)[:5] for r in got.collect()) == loop(rows)
    assert got.select("event_id").distinct().count() == len(loop(rows))
    assert changes.batch_events(df.limit(0)).count() == 0


def test_stream_in_batches_equals_one_run(spark, tmp_path):
    rows = observed(200, 6)
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = spark.createDataFrame([], changes.OBSERVED).schema
    for part in (rows[:70], rows[70:71] + rows[60:70], rows[71:]):  # some come twice
        spark.createDataFrame(part, changes.OBSERVED).write.mode("append").parquet(src)
        events.run_once(changes.stream_events(spark.readStream.schema(schema).parquet(src)), events.append_to(out), ckpt)
    events.run_once(changes.stream_events(spark.readStream.schema(schema).parquet(src)), events.append_to(out), ckpt)
    got = spark.read.schema(changes.EVENT).parquet(out).drop("batch")
    want = changes.batch_events(spark.createDataFrame(rows, changes.OBSERVED))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_expiring(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 31)), (3, dt.date(2024, 2, 1)), (4, None), (5, dt.date(2023, 12, 31))], "object_id long, end_date date")
    a = changes.expiring(df, "2024-01-01").collect()
    b = changes.expiring(df, "2024-01-02").collect()
    assert {r.object_id for r in a} == {1, 2} and {r.object_id for r in b} == {2, 3} and not {r.event_id for r in a} & {r.event_id for r in b}
    assert changes.expiring(df, "2024-01-01").where(F.col("event_type") != "contract.expiring").count() == 0
