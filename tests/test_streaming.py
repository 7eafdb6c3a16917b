"""Streams give what the same rows give as a table."""

from datetime import datetime, timedelta

from mnemolake.operators.lifecycle import feedback_fold
from mnemolake.streaming import feedback

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def _events(spark, n=200):
    types = ("purchase", "view", "click", "signup", "error", "view", "view")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), i % 5, types[(i * i + i // 3) % 7]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _sequential(rows):
    state = {}
    for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
        strength, uses = state.get(r.memory_id, (1, 0))
        if r.useful:
            strength, uses = strength + 1, uses + 1
        elif 3 <= uses * 2.5 < 10:
            strength = max(0, strength - 1)
        state[r.memory_id] = (strength, uses)
    return state


def test_fold_equals_a_sequential_pass(spark):
    rows = feedback.as_feedback(_events(spark))
    got = {r.memory_id: (r.strength, r.useful_count) for r in feedback_fold(rows).collect()}
    assert got == _sequential(rows.collect())


def test_streams(spark, tmp_path):
    events = _events(spark)
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feedback.keep_state(stream, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/ck").awaitTermination()
    got = {r.memory_id: (r.strength, r.useful_count) for r in spark.read.parquet(f"{tmp_path}/state").collect()}
    assert got == _sequential(feedback.as_feedback(events).collect())
    query = feedback.rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT * FROM rates").collect())) == sorted(map(tuple, feedback.rates(events).collect()))
