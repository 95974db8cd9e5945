"""State expiry by event time, late and refused requests, windowed counts of a stream."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palisade.operators import guard
from palisade.operators.policy import Config
from palisade.streaming.guard_stream import LATE, decide_stream, windowed_counts

FIELDS = "request_id string, agent_id string, role string, content string, source string, tool string, args array<struct<k:string,v:string>>, ts double"


def request(i, agent, ts, tool="web_search", role="ops", source="web"):
    return (f"r{i:03d}", agent, role, "Notes of the day.", source, tool, [], float(ts))


#: One list for each micro-batch; times in seconds.
T = 1_000_000.0
BATCHES = [
    [request(0, "a", T), request(1, "a", T + 1, "read_file"), request(2, "b", T + 2), request(3, None, T + 3), request(4, "c", T + 4, "nothing_known"), request(5, "d", T + 5)],
    [request(10, "b", T + 100, "read_file"), request(11, "b", T + 101, "send_email"), request(12, "e", T + 102, source="unknown")],
    [request(20, "e", T + 2000)],
    [request(30, "a", T + 1500, "read_file"), request(31, "e", T + 2100, "read_file")],  # the first is later than 60 s
    [request(40, "b", T + 5000), request(41, "e", T + 5001)],
    [request(60, "a", T + 9000), request(61, "e", T + 9001, "db_query")],
]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """What the stream gave, and the agents with state after each batch."""
    base = tmp_path_factory.mktemp("stream")
    (base / "in").mkdir()
    rows = spark.createDataFrame(BATCHES[0], FIELDS)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
    out, kept = decide_stream(source, Config(profile_ttl_s=3600), late="60 seconds"), []
    q = out.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(base / "cp")).start()
    for batch in BATCHES:
        spark.createDataFrame(batch, FIELDS).coalesce(1).write.mode("append").parquet(str(base / "in"))
        q.processAllAvailable()
        kept.append(json.loads(q.lastProgress.json)["stateOperators"][0]["numRowsTotal"])
    q.stop()
    return [r.asDict() for r in spark.table("answers").collect()], kept


def test_every_request_is_answered_once(streamed):
    rows, _ = streamed
    assert Counter(r["request_id"] for r in rows) == Counter(r[0] for b in BATCHES for r in b)
    kinds = {r["request_id"]: r["error"] for r in rows if r["error"]}
    assert kinds == {"r003": "agent_id must not be blank", "r012": "unknown source", "r030": LATE}
    assert all(r["verdict"] == "block" and not r["executed"] and r["why"] == [r["error"]] for r in rows if r["error"])


def test_old_state_goes(streamed):
    _, kept = streamed
    assert kept[0] == 4 and max(kept) == 5  # a, b, c, d, then e
    assert kept[-1] == 2  # of a and e; b, c and d did not call within the hour before the watermark


def test_decisions_stay_those_of_the_batch(spark, streamed):
    rows, _ = streamed
    every = [r for b in BATCHES for r in b if r[0] != "r030"]
    want = {r.request_id: (r.verdict, r.executed, r.tier, r.anomaly_score) for r in guard.decide(spark.createDataFrame(every, FIELDS)).collect()}
    assert {r["request_id"]: (r["verdict"], r["executed"], r["tier"], round(r["anomaly"], 4)) for r in rows if r["error"] != LATE} == want


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(T + s, v) for s, v in ((0, "allow"), (10, "allow"), (59, "block"), (61, "allow"), (4000, "allow"))]
    frame = spark.createDataFrame(rows, "ts double, verdict string").withColumn("at", F.timestamp_seconds("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "at").writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    closed = lambda df: {(r.window.start, r.verdict): r.n for r in df.collect()}
    got, batch = closed(spark.table("counted")), closed(windowed_counts(frame, "at"))
    assert sum(got.values()) == 4 and got.items() <= batch.items() and sum(batch.values()) == 5
