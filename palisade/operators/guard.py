"""The whole guard: requests in, decisions out.

Everything that depends on one request alone is a column over one scan plus broadcast joins; one
shuffle by agent feeds the behaviour fold; the rest is columns again.

A request has ``request_id, agent_id, role, content, source, tool, args, ts`` (``args`` an ordered
array of key and value, ``ts`` seconds as double).  Rows that cannot be judged (no agent, no role,
an unknown source, a blank tool) are blocked with an ``error``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..functions import egress as E, lexicon as L, rules as R, scrub as C, text as T
from . import behavior, policy
from .policy import Config
from .stored import once

SOURCES = ("user", "retrieval", "tool_output", "web", "memory")
DECISION = ["request_id", "agent_id", "role", "source", "tool", "verdict", "allowed", "executed", "tier", "injection_score", "anomaly_score", "exfiltration_attempt", "exfiltration_blocked", "exfiltrated", "would_block", "error", "reasons", "sanitized_content"]


def checked(requests: DataFrame) -> DataFrame:
    """Null content and args filled; ``error`` says why a row cannot be judged."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).cast("string").rlike(r"(?U)\S")
    error = (
        F.when(blank("agent_id"), "agent_id must not be blank")
        .when(blank("role"), "role must not be blank")
        .when(F.col("source").isNull() | ~F.col("source").isin(*SOURCES), "unknown source")
        .when(F.col("tool").isNotNull() & ~F.col("tool").rlike(r"(?U)\S"), "tool must not be blank")
        .when(F.col("ts").isNull(), "ts must not be null")
    )
    return requests.withColumns({"content": F.coalesce("content", F.lit("")), "args": F.coalesce("args", F.array().cast(T.ARGS)), "error": error})


def inspect(df: DataFrame, column: str, untrusted, into: str, model=None) -> DataFrame:
    """Adds ``into`` = struct(score, rule, is_injection, signals) of a text column.

    model: a function (df, column, into) that adds a probability, e.g. ``model.scorer``; without
    one the score is the rules' alone.
    """
    view, hits, looks = f"_{into}_view", f"_{into}_rules", hasattr(model, "look")
    df = T.with_view(df, column, view, guarded=looks)
    if looks:
        # one look at the text for both: which patterns can occur, and the learned score
        df = model.look(df, column, view, f"_{into}_p")
    df = R.with_rules(df, column, view, hits, may=model.can(f"_{into}_p") if looks else None)
    if model is not None and not looks:
        df = model(df, column, f"_{into}_p")
    p = F.col(f"_{into}_p") if model is not None else F.lit(0.0)
    blank = ~F.col(column).rlike(r"(?U)\S")
    df = df.withColumn(f"_{into}_s", F.when(blank, F.lit(0.0)).otherwise(R.rule_score(F.col(hits))))
    rule = F.col(f"_{into}_s")
    df = df.withColumn(f"_{into}_f", R.fuse(p, rule, untrusted, blank))
    score = F.col(f"_{into}_f")
    signals = F.when(F.size(hits) > 0, R.heaviest(F.col(hits)))
    if model is not None:
        features = model.features(f"_{into}_p") if looks else R.heuristics(F.col(column), F.col(view))
        signals = F.coalesce(signals, R.top_signals(features))
    df = df.withColumn(f"_{into}_g", F.coalesce(signals, F.array().cast("array<string>")))
    df = df.withColumn(into, F.struct(score.alias("score"), rule.alias("rule"), (score >= 0.30).alias("is_injection"), F.col(f"_{into}_g").alias("signals")))
    return df.drop(view, hits, *(f"_{into}_{x}" for x in "psfg"), *(model.left(f"_{into}_p") if looks else []))


def _scrubbed(df: DataFrame, column: str, into: str, redaction: str) -> DataFrame:
    return C.scrub(df, column, into, redaction, anchored=False)


@dataclass(frozen=True)
class Parts:
    """The guard's replaceable parts; each is a function of DataFrames or columns.

    inspect(df, column, untrusted, into, model) adds struct(score, rule, is_injection, signals);
    scrub(df, column, into, redaction) adds a struct with ``text``; route(trust, sens, is_egress, is_write)
    is the tier's rank before risk counts; clock is the time of a request in seconds; emit takes the
    decisions and returns what ``decide`` returns, such as audit records.
    """

    inspect: Callable = inspect
    scrub: Callable = _scrubbed
    route: Callable = policy.tier_rank
    clock: Callable = lambda: F.col("ts")
    emit: Callable = lambda decisions: decisions


def _facts(df: DataFrame, c: Config, enforce: bool) -> DataFrame:
    """Adds what depends on a tool and its arguments: facts, ``risky``, and what each tier would do (``run``)."""
    return _runs(E.with_facts(df, "args", c.secret_patterns, c.known_bad_destinations, c.internal_domains), c, enforce)


def _runs(df: DataFrame, c: Config, enforce: bool) -> DataFrame:
    df = df.withColumn("risky", F.col("is_egress") & (F.col("secret") | (F.size("ext") > 0)))
    for i, t in enumerate(L.TIERS):
        df = E.with_execution(df, i, c.tier_caps[t], f"_run{i}", enforce)
    return df.withColumn("run", F.array(*(F.col(f"_run{i}") for i in range(4))))


def _notes():
    """What is noted of a request's texts, from ``san``, ``arg`` and ``inj``."""
    args = F.when((F.col("arg.score") > F.col("san.score")) | (F.col("arg.score") >= 0.30), F.format_string("injection signal in tool arguments (%.2f)", F.col("arg.score")))
    signals = F.when(F.col("inj") >= 0.30, F.concat(F.lit("signals: "), F.array_join(F.when(F.col("arg.score") > F.col("san.score"), F.col("arg.signals")).otherwise(F.col("san.signals")), ", ")))
    return F.filter(F.array(args, signals), lambda r: r.isNotNull())


def _clean(c: Config):
    """Whether a text that was scrubbed may pass, from ``_again``."""
    return (F.col("_again.score") < c.thresholds.injection_block) & (F.col("_again.rule") < c.thresholds.injection_sanitize)


def steps(requests: DataFrame, c: Config | None = None, model=None, enforce: bool = True, parts: Parts | None = None) -> DataFrame:
    """All columns that the behaviour fold and the final projection read."""
    c, parts = c or Config(), parts or Parts()
    th = c.thresholds
    df = checked(requests.withColumn("ts", parts.clock().cast("double"))).where("error is null")
    df = policy.with_policy(df, c)
    df = df.withColumn("flat", T.flat_args(F.col("args")))
    too_long = F.length("content") > c.max_content_length
    df = df.withColumn("oversize", too_long | (F.col("tool").isNotNull() & (F.length("flat") > c.max_content_length)))
    df = df.withColumn("_content", F.when(too_long, F.lit("")).otherwise(F.col("content")))
    df = df.withColumn("_args", F.when(F.col("oversize") | F.col("tool").isNull(), F.lit("")).otherwise(F.col("flat")))
    untrusted = F.col("source") != "user"
    df = parts.inspect(df, "_content", untrusted, "san", model)
    df = parts.inspect(df, "_args", F.lit(True), "arg", model)
    df = df.withColumn("inj", F.greatest("san.score", "arg.score"))
    # what scrubbing the content would leave, for the verdicts that ask for it
    maybe = (F.col("inj") >= th.injection_sanitize) & (F.col("inj") < th.injection_block)
    df = df.withColumn("poisoned", F.when(maybe, F.col("_content")).otherwise(F.lit("")))
    df = _facts(df, c, enforce)
    df = df.withColumn("base_rank", parts.route(F.col("trust"), F.col("sens"), F.col("is_egress"), F.col("is_write")))
    df = df.withColumn("notes", _notes())
    # the one shuffle: what follows needs an agent's rows together; contents stay behind, but for
    # those that may be scrubbed
    df = df.select("agent_id", "role", "source", *behavior.STEP_IN, "notes", "poisoned").repartition("agent_id")
    df = parts.scrub(df, "poisoned", "_scrub", c.redaction).withColumn("left", F.col("_scrub.text")).drop("_scrub", "poisoned")
    df = parts.inspect(df, "left", F.col("source") != "user", "_again", model)
    return df.withColumn("clean", _clean(c)).drop("_again")


#: What a decision's columns are made from, where it is not a column of that name.
_FROM = {
    "injection_score": ["inj"], "anomaly_score": ["anomaly"], "exfiltration_attempt": ["exfil_attempt"], "exfiltration_blocked": ["exfil_blocked"], "error": [],
    "reasons": ["notes", "why", "inj", "text", "call"], "sanitized_content": ["scrubbed", "left", "text"],
}


def _read(wanted) -> set[str]:
    """The columns that the wanted ones of a decision are made from."""
    return {x for w in wanted for x in _FROM.get(w, [w])}


def _project(df: DataFrame, wanted=DECISION) -> DataFrame:
    """The decision's columns from the fold's rows; scores are exact to far more than nine places, so that halves round up."""
    short = lambda c: F.round(F.round(c, 9), 4)
    made = {
        "injection_score": lambda: short("inj"), "anomaly_score": lambda: short("anomaly"), "exfiltration_attempt": lambda: F.col("exfil_attempt"), "exfiltration_blocked": lambda: F.col("exfil_blocked"),
        "error": lambda: F.lit(None).cast("string"), "reasons": lambda: F.concat("notes", "why"), "sanitized_content": lambda: F.when(F.col("scrubbed"), F.col("left")),
    }
    return df.select(*(made[x]().alias(x) if x in made else F.col(x) for x in wanted))


def _refused(df: DataFrame, wanted=DECISION) -> DataFrame:
    """Decisions of requests that cannot be judged: blocked, with the error."""
    no, none = F.lit(False), F.lit(None).cast("string")
    return df.where("error is not null").select(
        "request_id", "agent_id", "role", "source", "tool", F.lit("block").alias("verdict"), no.alias("allowed"), no.alias("executed"), none.alias("tier"), F.lit(0.0).alias("injection_score"),
        F.lit(0.0).alias("anomaly_score"), no.alias("exfiltration_attempt"), no.alias("exfiltration_blocked"), no.alias("exfiltrated"), F.lit(True).alias("would_block"), "error", F.array("error").alias("reasons"), none.alias("sanitized_content"),
    ).select(*wanted)


#: Distinct texts, or calls, up to which each is judged once and looked up (they are broadcast), the bytes that
#: they may have together, and rows of a task that judges them.
REUSED, REUSED_BYTES, REUSED_ROWS = 1 << 15, 16 << 20, 2048


def _repeated(asked: DataFrame) -> tuple[int, int] | None:
    """About how many distinct texts and calls there are, or None if they are too many or too long to be broadcast."""
    n_args, joined = F.size("args"), lambda part: F.octet_length(F.array_join(F.col(f"args.{part}"), "", "None"))
    rows = asked.select(
        F.xxhash64("content", F.col("source") != "user").alias("text"), F.xxhash64("tool", "args").alias("call"),
        F.octet_length("content").alias("text_bytes"), F.when(n_args > 0, joined("k") + joined("v") + 2 * n_args - 1).otherwise(F.lit(0)).alias("call_bytes"),
    )
    # the sketches' updates are interpreted: they see each pair once, found by compiled code, not each request
    pairs = rows.groupBy("text", "call").agg(F.max("text_bytes").alias("text_bytes"), F.max("call_bytes").alias("call_bytes"))
    about, longest = lambda x: F.approx_count_distinct(x, 0.02), lambda x: F.coalesce(F.max(x), F.lit(0))
    n = pairs.agg(about("text"), about("call"), longest("text_bytes"), longest("call_bytes")).first()
    few = all(n[i] <= REUSED and n[i] * n[i + 2] <= REUSED_BYTES for i in (0, 1))
    return (n[0], n[1]) if few else None


def with_facts_once(df: DataFrame, c: Config, wanted: list[str]) -> DataFrame:
    """Adds ``wanted`` of what ``egress.with_facts`` finds in ``args``; each distinct list of arguments is judged once."""
    args = df.select("args").distinct()
    judged = once(E.with_facts(args, "args", c.secret_patterns, c.known_bad_destinations, c.internal_domains).select(F.col("args").alias("_args"), *wanted))
    n, size = judged.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    few = n <= REUSED and size <= REUSED_BYTES
    return df.join(F.broadcast(judged) if few else judged, F.col("args").eqNullSafe(F.col("_args"))).drop("_args")


def _together(spark, *makers) -> list:
    """The results of functions that run Spark jobs at the same time."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f)) for f in makers]]


def _distinct(asked: DataFrame) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Distinct texts and distinct calls, stored, with about how many there are; None if they are too many.

    They are found while they are counted; if they are too many, finding them is given up.
    """
    sc, tag = asked.sparkSession.sparkContext, f"distinct-{uuid4().hex}"

    def kept(df):
        sc.addJobTag(tag)
        return once(df.distinct())

    wanted = asked.select("content", (F.col("source") != "user").alias("_untrusted")), asked.select("tool", "args")
    with ThreadPoolExecutor(2) as pool:
        found = [pool.submit(inheritable_thread_target(asked.sparkSession)(partial(kept, df))) for df in wanted]
        try:
            few = _repeated(asked)
        except BaseException:
            few = None
            raise
        finally:
            # a job that begins later is met by the next turn
            while not few and wait(found, 0.2).not_done:
                sc.cancelJobsWithTag(tag)
        return (*(x.result() for x in found), *few) if few else None


def _judged(asked: DataFrame, c: Config, model, parts: Parts, texts: DataFrame, calls: DataFrame, n_texts: int, n_calls: int, arms: tuple[bool, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """Each of the distinct texts and calls of requests that can be judged, with a number and what was found;
    the calls for each of ``arms``, with what tiers would do.

    Contents, what scrubbing leaves of them and calls as text are inspected together: a plan of all rules is planned
    and compiled once. What does not need each other runs at the same time: each is a row of short jobs of few tasks.
    """
    rank = F.monotonically_increasing_id()
    dealt = lambda df, n: df.repartition(1 + n // REUSED_ROWS)

    def of_texts():
        every = dealt(texts, n_texts).withColumn("_long", F.length("content") > c.max_content_length)
        every = every.withColumn("_content", F.when(F.col("_long"), F.lit("")).otherwise(F.col("content")))
        # of a text that is blocked by itself, what is left is never read
        every = parts.scrub(every, "_content", "_scrub", c.redaction)
        return once(every.select("content", "_untrusted", "_long", "_content", F.col("_scrub.text").alias("left"), rank.alias("text")))

    def of_calls():
        every = policy.with_tool(dealt(calls, n_calls), c).withColumn("flat", T.flat_args(F.col("args")))
        every = every.withColumn("_call_long", F.col("tool").isNotNull() & (F.length("flat") > c.max_content_length))
        every = every.withColumn("_args", F.when(F.col("_call_long") | F.col("tool").isNull(), F.lit("")).otherwise(F.col("flat")))
        return once(E.with_facts(every, "args", c.secret_patterns, c.known_bad_destinations, c.internal_domains).withColumn("call", rank))

    scrubbed, known = _together(asked.sparkSession, of_texts, of_calls)
    said = scrubbed.select(F.col("_content").alias("_said"), F.col("_untrusted").alias("_far")).union(scrubbed.select("left", "_untrusted")).union(known.select("_args", F.lit(True)))
    said = once(inspect(dealt(said.distinct(), 2 * n_texts + n_calls), "_said", F.col("_far"), "_of", model))

    def found(df, column, untrusted, into):
        of = F.broadcast(said.withColumnRenamed("_of", into))
        return df.join(of, F.col(column).eqNullSafe(F.col("_said")) & (untrusted == F.col("_far")), "left").drop("_said", "_far")

    def judged_texts():
        both = found(found(scrubbed, "_content", F.col("_untrusted"), "san"), "left", F.col("_untrusted"), "_again")
        return once(both.select("content", "_untrusted", "_long", "san", "left", _clean(c).alias("clean"), "text"))

    def judged_calls(enforce):
        of_tool = ("sens", "floor", "is_egress", "is_write", "is_read")
        both = _runs(found(known, "_args", F.lit(True), "arg"), c, enforce)
        return once(both.select(F.col("tool").alias("_tool"), F.col("args").alias("_args"), *of_tool, "_call_long", "arg", "risky", "run", "call"))

    texts_, *calls_ = _together(asked.sparkSession, judged_texts, *(partial(judged_calls, on) for on in arms))
    return texts_, calls_


def _looked_up(asked: DataFrame, c: Config, enforce: bool, parts: Parts, texts: DataFrame, calls: DataFrame, wanted) -> DataFrame:
    """The fold's rows of requests that can be judged, from what was found of their texts and calls.

    Only numbers of texts and calls go through the shuffle by agent; their signals, the scrubbed texts and what
    tiers would do are looked up by number.
    """
    spark = asked.sparkSession
    asked = asked.withColumn("_untrusted", F.col("source") != "user")
    of_tool = ("sens", "floor", "is_egress", "is_write", "is_read")
    # what a role may do is looked up behind the shuffle: all joins of one stage become one method, and Java runs
    # methods of more than 8000 bytes uncompiled, several times as slowly
    df = asked.join(F.broadcast(texts.select("content", "_untrusted", "_long", "clean", "text", F.col("san.score").alias("_san"))), ["content", "_untrusted"], "left")
    same = F.col("tool").eqNullSafe(F.col("_tool")) & (F.col("args") == F.col("_args"))
    df = df.join(F.broadcast(calls.select("_tool", "_args", *of_tool, "_call_long", "risky", "call", F.col("arg.score").alias("_arg"))), same, "left")
    df = df.withColumns({"oversize": F.col("_long") | F.col("_call_long"), "inj": F.when(F.col("_long"), F.lit(0.0)).otherwise(F.greatest("_san", "_arg"))})
    df = df.select("agent_id", "role", "source", "ts", "request_id", "tool", *of_tool, "oversize", "inj", "clean", "risky", "text", "call")
    # agents are few and of any size: many small parts are dealt out more evenly than few large ones
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    df = df.repartition(dealt, "agent_id")
    df = policy.with_role(df, c).withColumn("base_rank", parts.route(F.col("trust"), F.col("sens"), F.col("is_egress"), F.col("is_write")))
    df = df.select("agent_id", "role", "source", *(x for x in behavior.STEP if x != "run"), "text", "call")
    tiers = lambda run: [{k: x[k] for k in ("ok", "attempt", "leaked", "reason")} for x in run]
    runs = {r.call: (r._tool, r.sens, r.risky, r.is_read, tiers(r.run)) for r in calls.select("call", "_tool", "sens", "risky", "is_read", "run").collect()}
    df = behavior.fold(df, c, enforce, together=True, runs=spark.sparkContext.broadcast(runs), wanted=_read(wanted))
    if {"reasons", "sanitized_content"} & {*wanted}:
        df = df.join(F.broadcast(texts.select("text", "_long", "san", "left")), "text", "left")
    if "reasons" not in wanted:
        return df
    df = df.join(F.broadcast(calls.select("call", F.col("arg").alias("_of_call"))), "call", "left")
    blank = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("rule"), F.lit(False).alias("is_injection"), F.array().cast("array<string>").alias("signals"))
    return df.withColumn("arg", F.when(F.col("_long"), blank).otherwise(F.col("_of_call"))).withColumn("notes", _notes())


def _decided(requests: DataFrame, c: Config, model, parts: Parts, arms: tuple[bool, ...], wanted) -> list[DataFrame]:
    """The decisions of a guard for each of ``arms`` (whether it enforces); what can be is judged once for all."""
    wanted = [x for x in DECISION if wanted is None or x in wanted]
    timed = requests.withColumn("ts", parts.clock().cast("double"))
    asked = checked(timed).where("error is null")
    few = _distinct(asked) if parts.inspect is inspect and parts.scrub is _scrubbed else None
    texts, calls = _judged(asked, c, model, parts, *few, arms) if few else (None, arms)
    alone = lambda on: behavior.fold(steps(requests, c, model, on, parts), c, on, together=True, wanted=_read(wanted))
    made = [_looked_up(asked, c, on, parts, texts, of_arm, wanted) if few else alone(on) for on, of_arm in zip(arms, calls)]
    return [parts.emit(_project(df, wanted).unionByName(_refused(checked(timed), wanted))) for df in made]


def decide(requests: DataFrame, c: Config | None = None, model=None, enforce: bool = True, parts: Parts | None = None, wanted=None) -> DataFrame:
    """A decision for every request; one shuffle, joins only with the policy's dimensions and with few distinct
    texts and calls, which are counted first (unless parts are replaced that may read other columns).

    wanted: the columns of ``DECISION`` that are read later; the others are not made."""
    return _decided(requests, c or Config(), model, parts or Parts(), (enforce,), wanted)[0]


def decide_arms(requests: DataFrame, c: Config | None = None, model=None, parts: Parts | None = None, wanted=None) -> tuple[DataFrame, DataFrame]:
    """What ``decide`` gives for a guard that enforces, and for one that only watches; texts and calls are judged once."""
    protected, watched = _decided(requests, c or Config(), model, parts or Parts(), (True, False), wanted)
    return protected, watched
