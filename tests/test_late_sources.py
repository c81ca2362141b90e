"""Captions merged while sources still arrive, against the batch merge of all of them."""

import pytest

from tagweave.operators.merge import merge_captions
from tagweave.streaming.late_sources import STATE_STORE, merged_now, run_merge

SCHEMA = "name string, text string, source_ord int"
ARRIVALS = [
    [("a", "red, blue", 2), ("b", "one, two", 1), ("a", "blue, green", 2)],
    [("a", "first, red", 1), ("c", "", 1), (None, "x, y", 1)],
    [("a", "first, red", 1), ("b", "two, three", 3), ("d", None, 1), ("c", "late", 2)],
    [(None, "y, z", 0), ("b", "zero", 0), ("b", "zero", 0)],
]


@pytest.fixture()
def keyed_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.set(key, old)


def test_stream_of_late_sources_equals_the_batch_merge(spark, keyed_state, tmp_path):
    given, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    seen = []
    for rows in ARRIVALS:  # a new run for every arrival: state and offsets come back from the checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(given)
        seen += rows
        run_merge(spark.readStream.schema(SCHEMA).parquet(given), out, "late", state).awaitTermination()
        want = merge_captions(spark.createDataFrame(seen, SCHEMA))
        assert sorted(map(tuple, merged_now(spark, out).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    sent = spark.read.parquet(out).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in sent} == {"a": 2, "b": 3, "c": 2, "d": 1, None: 2}
