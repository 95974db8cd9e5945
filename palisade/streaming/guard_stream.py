"""The guard over a stream of requests: the batch plan with keyed state for behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import behavior, guard
from ..operators.policy import Config

_STATE = "tools array<string>, attempts array<double>, blocks array<double>, read_at double, allowed long, seen double"
OUT = f"agent_id string, request_id string, ts double, injection_score double, {behavior.OUT}, error string"
#: Why a request that came too late is blocked.
LATE = "later than the watermark"


def _beats(steps: DataFrame, late: str) -> DataFrame:
    """Each step twice: as a beat, whose time moves the watermark, and as itself, without one.

    Spark drops what is later than the watermark before a state function sees it.  A step that has no event
    time is never dropped, so the function can answer late ones too.
    """
    rows = steps.withColumn("beat", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("run", F.when(~F.col("beat"), F.col("run")))  # the rest is a few numbers
    rows = rows.withColumn("at", F.when(F.col("beat"), F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))))
    return rows.withWatermark("at", late)


def decide_stream(requests: DataFrame, c: Config | None = None, model=None, enforce: bool = True, late: str = "10 minutes") -> DataFrame:
    """A row of ``OUT`` for every request of a stream, in append mode.

    Requests of one micro-batch are taken by time and request id.  Three kinds of rows, told apart by
    ``error``: decided (null), arrived after the watermark had passed their time (``LATE``; blocked, and the
    agent's state is left alone), and those that cannot be judged (why not; blocked).  An agent's state
    goes by an event-time timer once the watermark is ``profile_ttl_s`` past its last call: from then on a
    request in time would start anew in any case, so decisions stay those of the batch.
    """
    import pandas as pd

    c = c or Config()
    steps = guard.steps(requests, c, model, enforce).select("agent_id", *behavior.STEP)
    fields = [f.split()[0] for f in behavior.OUT.split(", ")]
    names = [f.split()[0] for f in OUT.split(", ")]

    def plain(run):
        return [r if isinstance(r, dict) else r.asDict() for r in run]

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs()
        s = behavior.State.unpack(state.get) if state.exists else behavior.State()
        rows = pd.concat(list(frames))
        rows = rows[~rows["beat"].astype(bool)].sort_values(["ts", "request_id"], kind="stable").to_dict("records")
        done = []
        for r in rows:
            if 0 < watermark and r["ts"] * 1000 <= watermark:
                d, error = _blocked(LATE), LATE
            else:
                r["tool"] = None if pd.isna(r["tool"]) else r["tool"]
                r["run"] = plain(r["run"])
                s, d = behavior.step(s, r, c, enforce)
                error = None
            done.append([key[0], r["request_id"], r["ts"], r["inj"], *(d[f] for f in fields), error])
        if s.seen is not None:
            state.update(s.pack())
            state.setTimeoutTimestamp(max(int((s.seen + c.profile_ttl_s) * 1000), watermark) + 1)
        yield pd.DataFrame(done, columns=names)

    decided = _beats(steps, late).groupBy("agent_id").applyInPandasWithState(update, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    refused = guard.checked(requests).where("error is not null")
    kinds = dict(f.split(" ", 1) for f in behavior.OUT.split(", "))
    blocked = {f: F.array("error") if f == "why" else F.lit(v).cast(kinds[f]) for f, v in _blocked("").items()}
    refused = refused.select("agent_id", "request_id", F.col("ts").cast("double").alias("ts"), F.lit(0.0).alias("injection_score"), *(blocked[f].alias(f) for f in fields), "error")
    return decided.unionByName(refused)


def _blocked(why: str) -> dict:
    """The fold's columns of a request that is blocked without being judged."""
    no = dict.fromkeys(("allowed", "executed", "exfil_attempt", "exfil_blocked", "exfiltrated", "scrubbed"), False)
    return {"verdict": "block", "tier": None, "anomaly": 0.0, "would_block": True, "why": [why], **no}


def windowed_counts(decisions: DataFrame, ts: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, verdict, n) of decisions with a timestamp column, as a table or as a stream.

    In a stream a window is given once the watermark has passed its end; rows later than that are not in it.
    Those of ``decide_stream`` that came too late carry an error and can be counted apart.
    """
    return decisions.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "verdict").agg(F.count("*").alias("n"))
