"""Per-agent behaviour: the transition of one step, and the batch fold over ordered steps.

A step reads the agent's state, scores how unusual the step is, takes the verdict and the tier,
looks up what the tier would do with the call, and writes back what the outcome teaches.  Order is
event time, then request id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon as L
from . import bands
from .policy import Config

#: Most attempts and blocks that are remembered of one agent.
ATTEMPTS, BLOCKS = 256, 64


def _rising(times) -> bool:
    return all(a <= b for a, b in pairwise(times))


@dataclass
class State:
    """What is remembered of one agent; ``rising``: whether its times came in order, as they do but for late requests of a stream."""

    tools: set = field(default_factory=set)
    attempts: deque = field(default_factory=lambda: deque(maxlen=ATTEMPTS))
    blocks: deque = field(default_factory=lambda: deque(maxlen=BLOCKS))
    read_at: float | None = None
    allowed: int = 0
    seen: float | None = None
    rising: bool = True

    def pack(self) -> tuple:
        return sorted(self.tools), list(self.attempts), list(self.blocks), self.read_at, self.allowed, self.seen

    def at(self, t: float, c: Config) -> State:
        """The state at time t: a new one after too long a pause."""
        s = State() if self.seen is not None and t - self.seen > c.profile_ttl_s else self
        s.seen = t
        return s

    def _note(self, times: deque, t: float) -> None:
        self.rising = self.rising and (not times or times[-1] <= t)
        times.append(t)

    def _lately(self, times: deque, t: float, seconds: float) -> int:
        """How many of the times are no more than seconds before t."""
        if self.rising:
            if times and t - times[0] <= seconds:
                return len(times)
            return len(times) - bisect_left(times, -seconds, key=lambda x: x - t)
        return sum(t - x <= seconds for x in times)

    def unusual(self, t: float, tool: str, critical: bool, risky: bool, c: Config) -> tuple[float, list[str]]:
        """Count this attempt, and say how unusual it is: the noisy-or of all signs, and why."""
        self._note(self.attempts, t)
        lately = self._lately(self.attempts, t, c.rate_window_s)
        blocked = self._lately(self.blocks, t, c.block_window_s) if self.blocks else 0
        usual, why = 1.0, []
        if lately > c.rate_limit:
            usual *= 1.0 - min(0.6, 0.3 + 0.3 * (lately - c.rate_limit) / c.rate_limit)
            why.append(f"{lately} calls within {c.rate_window_s:g} seconds")
        if self.allowed >= 3 and tool not in self.tools:
            usual *= 1.0 - 0.25
            why.append(f"never used '{tool}' before")
        if risky and self.read_at is not None and t - self.read_at <= c.sensitive_read_window_s:
            usual *= 1.0 - 0.7
            why.append("sends data out shortly after a sensitive read")
        if critical and self.allowed == 0:
            usual *= 1.0 - 0.25
            why.append("begins with a critical tool")
        if blocked:
            usual *= 1.0 - min(0.5, 0.2 * blocked)
            why.append(f"blocked {blocked} times shortly before")
        return 1.0 - usual, why

    def learn(self, t: float, outcome: str, tool: str | None = None, is_read: bool = False) -> None:
        """Take in how an attempt ended: allow, quarantine or block."""
        if outcome == "block":
            self._note(self.blocks, t)
            return
        if is_read:
            self.read_at = t
        if outcome == "allow":
            self.tools.add(tool)
            self.allowed += 1

    @classmethod
    def unpack(cls, t) -> State:
        tools, attempts, blocks, read_at, allowed, seen = t
        return cls(set(tools), deque(attempts, ATTEMPTS), deque(blocks, BLOCKS), read_at, allowed, seen, _rising(attempts) and _rising(blocks))


#: What the fold reads of a step, after agent_id.
STEP_IN = ["ts", "request_id", "tool", "sens", "policy", "oversize", "inj", "risky", "base_rank", "is_read", "run"]
STEP = ["ts", "request_id", "tool", "sens", "policy", "oversize", "inj", "clean", "risky", "base_rank", "is_read", "run"]
OUT = "verdict string, allowed boolean, executed boolean, tier string, anomaly double, would_block boolean, exfil_attempt boolean, exfil_blocked boolean, exfiltrated boolean, scrubbed boolean, why array<string>"


FIELDS = [f.split()[0] for f in OUT.split(", ")]
#: What only the fold reads of a step; it is not handed on.
SPENT = {"ts", "sens", "policy", "oversize", "clean", "risky", "base_rank", "is_read", "run"}


def step(s: State, row: dict, c: Config, enforce: bool = True) -> tuple[State, dict]:
    """One request: the new state and the decision."""
    s, done = _step(s, *(row[x] for x in _READ), row["run"], c, enforce)
    return s, dict(zip(FIELDS, done))


_READ = ["ts", "tool", "sens", "policy", "oversize", "inj", "clean", "risky", "base_rank", "is_read"]
#: What depends on the call alone.
OF_CALL = ["tool", "sens", "risky", "is_read", "run"]


def _step(s: State, t: float, tool, sens, policy, oversize, inj: float, clean, risky, rank: int, is_read, runs: list[dict], c: Config, enforce: bool) -> tuple[State, tuple]:
    """One request from its values: the new state and the decision's values, in the order of ``OUT``."""
    if oversize:
        if tool is not None:
            s = s.at(t, c)
            s.learn(t, "block")
        return s, ("block", False, False, None, 0.0, True, False, False, False, False, ["oversize input is blocked"])
    th = c.thresholds
    forced, anomaly, scrubbed = False, 0.0, False
    if tool is None:
        verdict = "block" if inj >= th.injection_block else "sanitize" if inj >= th.injection_sanitize else "allow"
        why = [f"no tool call: {verdict}"]
    elif policy == "hard":
        verdict, why = "block", ["policy forbids the call"]
    elif policy == "soft":
        verdict, forced, why = "quarantine", True, ["trust below the floor"]
    else:
        s = s.at(t, c)
        anomaly, why = s.unusual(t, tool, sens == "critical", risky, c)
        risky_level = sens in ("high", "critical")
        if inj >= th.injection_block or risky_level and inj >= th.injection_sanitize or risky_level and anomaly >= th.anomaly_block:
            verdict = "block"
        elif anomaly >= th.anomaly_quarantine:
            verdict, forced = "quarantine", True
        else:
            verdict = "sanitize" if inj >= th.injection_sanitize else "allow"
    would_block = verdict == "block"
    if would_block and not enforce:
        verdict = "allow"
        why.append("monitor only: would block")
    if verdict == "sanitize":
        scrubbed = True
        if clean:
            verdict = "allow"
        else:
            would_block = True
            why.append("injection is still there after scrubbing")
            verdict = "block" if enforce else "allow"
    if verdict == "block":
        if tool is not None:
            s = s.at(t, c)
            s.learn(t, "block")
        return s, (verdict, False, False, None, anomaly, would_block, False, False, False, scrubbed, why)
    if tool is None:
        return s, (verdict, True, False, None, anomaly, would_block, False, False, False, scrubbed, why)
    risk = 1 - (1 - inj) * (1 - anomaly)
    rank = 0 if forced or risk >= 0.60 else min(rank, 1) if risk >= 0.35 else rank
    run = runs[rank]
    ok, attempt, leaked = run["ok"], run["attempt"], run["leaked"]
    if not ok:
        why.append(run["reason"])
        verdict = verdict if verdict == "quarantine" else "block"
    if verdict == "block":
        s = s.at(t, c)
        s.learn(t, "block")
    elif ok:
        s = s.at(t, c)
        s.learn(t, verdict, tool, is_read)
    return s, (verdict, ok, ok, L.TIERS[rank], anomaly, would_block or attempt, attempt, attempt and not leaked, leaked, scrubbed, why)


def _values(a: pa.Array) -> list:
    """A column's values; a text that occurs often is made once."""
    if pa.types.is_string(a.type):
        a = a.dictionary_encode()
        texts = [*a.dictionary.to_pylist(), None]
        return [texts[i] for i in a.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False).tolist()]
    plain = a.null_count == 0 and (pa.types.is_floating(a.type) or pa.types.is_integer(a.type) or pa.types.is_boolean(a.type))
    return a.to_numpy(zero_copy_only=False).tolist() if plain else a.to_pylist()


def fold(steps: DataFrame, c: Config, enforce: bool = True, together: bool = False, runs=None, wanted=None) -> DataFrame:
    """steps with the decision's columns, without those that only the fold reads (``SPENT``).

    One shuffle by agent (none if the rows of an agent are ``together``), then a stream over rows
    sorted by agent, time and request id: memory holds one agent's bounded state, so an agent with a
    third of all rows costs no more memory.  runs: what is known of calls (``OF_CALL``), by the number ``call``, as a
    broadcast; without it each step brings it.  wanted: the columns that are read later, which Spark cannot find out
    through a Python function; None: all.
    """
    rows = steps if together else steps.repartition("agent_id")
    rows = rows.sortWithinPartitions("agent_id", "ts", "request_id")
    kinds = dict(zip(FIELDS, [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), *[pa.bool_()] * 5, pa.list_(pa.string())]))
    given = [(i, x) for i, x in enumerate(FIELDS) if wanted is None or x in wanted] or [(0, FIELDS[0])]
    kept = [f for f in rows.schema.fields if f.name not in SPENT and (wanted is None or f.name in wanted)]
    names = [f.name for f in kept]
    of_step = [x for x in _READ if x not in OF_CALL]
    of_call = OF_CALL if runs is None else ["call"]
    rows = rows.select(*dict.fromkeys([*names, "agent_id", *of_step, *of_call]))

    def run(batches):
        agent, state, started = None, State(), False
        known = runs and runs.value
        for b in batches:
            done = []
            values = [_values(b.column(x)) for x in of_call]
            calls = zip(*values) if known is None else map(known.__getitem__, *values)
            for own, (tool, sens, risky, is_read, of_tiers), t, policy, oversize, inj, clean, rank in zip(_values(b.column("agent_id")), calls, *(_values(b.column(x)) for x in of_step)):
                if not started or own != agent:
                    agent, state, started = own, State(), True
                state, d = _step(state, t, tool, sens, policy, oversize, inj, clean, risky, rank, is_read, of_tiers, c, enforce)
                done.append(d)
            columns = list(zip(*done)) or [()] * len(FIELDS)
            made = [pa.array(columns[i], kinds[x]) for i, x in given]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *made], names=[*names, *(x for _, x in given)])

    from pyspark.sql.types import StructType

    return rows.mapInArrow(run, StructType([*kept, *(StructType.fromDDL(OUT)[x] for _, x in given)]))


# ---- parts of the fold that need no feedback, as plain windows ---------------------------------------


def in_window(df: DataFrame, key: str, ts: str, seconds: float, weight=None, into: str = "recent") -> DataFrame:
    """Adds how many rows of the key lie in the seconds up to a row, or the sum of their weights."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return bands.active_sum(df.withColumn("_us", us), key, "_us", seconds, F.lit(1) if weight is None else weight, into).drop("_us")


def sessions(df: DataFrame, key: str, ts: str, gap: float, tie: str) -> DataFrame:
    """Adds ``session``: a new number after a pause of more than gap seconds."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > int(gap * 1_000_000)).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
