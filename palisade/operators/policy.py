"""Access policy: configuration and the dimension tables that requests are joined with."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import lexicon as L

LEVELS = ("low", "medium", "high", "critical")


class GuardError(Exception):
    """Base of the errors of this package."""


class ConfigError(GuardError, ValueError):
    """A configuration that cannot be used."""


class ValidationError(GuardError, ValueError):
    """A request that cannot be judged."""


class ModelIntegrityError(GuardError):
    """A stored model that does not match its manifest."""


@dataclass(frozen=True)
class Thresholds:
    injection_block: float = 0.80
    injection_sanitize: float = 0.30
    anomaly_quarantine: float = 0.55
    anomaly_block: float = 0.85


@dataclass(frozen=True)
class Config:
    """All settings; immutable, so every guard may keep its own."""

    role_trust: dict = field(default_factory=lambda: dict(L.ROLE_TRUST))
    role_tool_matrix: dict = field(default_factory=lambda: {k: set(v) for k, v in L.ROLE_TOOLS.items()})
    tool_sensitivity: dict = field(default_factory=lambda: dict(L.TOOL_SENSITIVITY))
    sensitivity_trust_floor: dict = field(default_factory=lambda: dict(L.TRUST_FLOORS))
    thresholds: Thresholds = field(default_factory=Thresholds)
    egress_tools: frozenset = frozenset(L.EGRESS_TOOLS)
    write_tools: frozenset = frozenset(L.WRITE_TOOLS)
    secret_tools: frozenset = frozenset(L.SECRET_TOOLS)
    tier_caps: dict = field(default_factory=lambda: dict(L.TIER_CAPS))
    known_bad_destinations: frozenset = frozenset(L.KNOWN_BAD)
    secret_patterns: tuple = tuple(L.SECRETS)
    internal_domains: tuple = tuple(L.INTERNAL_DOMAINS)
    rate_window_s: float = 1.0
    rate_limit: int = 20
    max_agents: int = 100_000
    profile_ttl_s: float = 3600.0
    sensitive_read_window_s: float = 300.0
    block_window_s: float = 60.0
    max_content_length: int = 100_000
    redaction: str = L.REDACTION

    def __post_init__(self):
        validate(self)

    def copy(self, **changes) -> Config:
        """An independent copy with changes."""
        return replace(copy.deepcopy(self), **changes)


def validate(c: Config) -> None:
    """Raise ConfigError unless ranges, names and orders hold."""

    def need(ok, what):
        if not ok:
            raise ConfigError(what)

    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    t = c.thresholds
    for f in fields(t):
        v = getattr(t, f.name)
        need(number(v) and 0 <= v <= 1, f"threshold {f.name} must lie in [0, 1]: {v!r}")
    need(t.injection_sanitize <= t.injection_block, "injection_sanitize must not exceed injection_block")
    need(t.anomaly_quarantine <= t.anomaly_block, "anomaly_quarantine must not exceed anomaly_block")
    for role, v in c.role_trust.items():
        need(number(v) and 0 <= v <= 1, f"trust of role {role} must lie in [0, 1]: {v!r}")
    for tool, level in c.tool_sensitivity.items():
        need(level in LEVELS, f"tool {tool} has an unknown sensitivity: {level!r}")
    for level in LEVELS:
        v = c.sensitivity_trust_floor.get(level)
        need(number(v) and 0 <= v <= 1, f"the trust floor of {level} must lie in [0, 1]: {v!r}")
    need(set(c.tier_caps) == set(L.TIERS), "all four tiers need capabilities")
    for tier, (egress, files, secrets, _) in c.tier_caps.items():
        need(egress in ("none", "allowlist", "broad") and files in ("none", "ro", "scratch") and secrets in ("none", "scoped", "full"), f"unknown capability of tier {tier}")
    for name in ("rate_window_s", "profile_ttl_s", "sensitive_read_window_s", "block_window_s", "rate_limit", "max_agents", "max_content_length"):
        need(number(getattr(c, name)) and getattr(c, name) > 0, f"{name} must be positive")


# ---- dimension tables ------------------------------------------------------------------------------


def _dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as part of the plan; as a list of Python rows, each use would start a Python worker on every core."""
    fields = StructType.fromDDL(schema).fields
    columns = zip(*rows) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({f.name: pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(fields, columns)}), schema)


def tool_dim(spark: SparkSession, c: Config) -> DataFrame:
    """(tool, sens, is_egress, is_write, is_secret, is_read); a few rows."""
    names = sorted({*c.tool_sensitivity, *c.egress_tools, *c.write_tools, *c.secret_tools, *L.READ_TOOLS})
    rows = [(t, c.tool_sensitivity.get(t, "high"), t in c.egress_tools, t in c.write_tools, t in c.secret_tools, t in L.READ_TOOLS) for t in names]
    return _dim(spark, rows, "tool string, sens string, is_egress boolean, is_write boolean, is_secret boolean, is_read boolean")


def role_dim(spark: SparkSession, c: Config) -> DataFrame:
    return _dim(spark, sorted(c.role_trust.items()), "role string, trust double")


def role_tool_dim(spark: SparkSession, c: Config) -> DataFrame:
    rows = sorted((r, t, True) for r, tools in c.role_tool_matrix.items() for t in tools)
    return _dim(spark, rows, "role string, tool string, permitted boolean")


def floor_dim(spark: SparkSession, c: Config) -> DataFrame:
    return _dim(spark, sorted(c.sensitivity_trust_floor.items()), "sens string, floor double")


def with_tool(df: DataFrame, c: Config) -> DataFrame:
    """Adds what the policy says of a tool: sens, flags and floor.

    The dimensions come from the configuration, a few dozen rows, so they are broadcast.  Unknown
    tools count as high, unknown levels need full trust.
    """
    spark, no = df.sparkSession, F.lit(False)
    df = df.join(F.broadcast(tool_dim(spark, c)), "tool", "left")
    df = df.withColumn("sens", F.coalesce("sens", F.lit("high"))).join(F.broadcast(floor_dim(spark, c)), "sens", "left")
    return df.withColumns({"floor": F.coalesce("floor", F.lit(1.0)), **{x: F.coalesce(x, no) for x in ("is_egress", "is_write", "is_secret", "is_read")}})


def with_role(df: DataFrame, c: Config) -> DataFrame:
    """Adds trust, permitted and ``policy`` (ok, hard, soft, none) to what ``with_tool`` says; unknown roles have trust 0."""
    spark = df.sparkSession
    df = df.join(F.broadcast(role_dim(spark, c)), "role", "left").join(F.broadcast(role_tool_dim(spark, c)), ["role", "tool"], "left")
    df = df.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "permitted": F.coalesce("permitted", F.lit(False))})
    return df.withColumn("policy", policy_status(F.col("tool"), F.col("permitted"), F.col("trust"), F.col("floor"), F.col("sens")))


def with_policy(df: DataFrame, c: Config) -> DataFrame:
    """Adds trust, sens, flags, floor, permitted and ``policy`` (ok, hard, soft, none)."""
    return with_role(with_tool(df, c), c)


def policy_status(tool: Column, permitted: Column, trust: Column, floor: Column, sens: Column) -> Column:
    """ok; hard (not permitted, or high and critical below the floor); soft; none without a tool."""
    return F.when(tool.isNull(), "none").when(~permitted, "hard").when(trust >= floor, "ok").when(sens.isin("high", "critical"), "hard").otherwise("soft")


def tier_rank(trust: Column, sens: Column, is_egress: Column, is_write: Column) -> Column:
    """The tier by trust; sensitive tools that neither send nor write are read-only at most."""
    base = F.when(trust >= 0.90, 3).when(trust >= 0.60, 2).when(trust >= 0.30, 1).otherwise(0)
    return F.when(sens.isin("high", "critical") & ~is_egress & ~is_write, F.least(base, F.lit(1))).otherwise(base)


def isolate(rank: Column, risk: Column, forced: Column) -> Column:
    """The tier after risk: 0.60 or force isolates, 0.35 makes it read-only at most."""
    return F.when(forced | (risk >= 0.60), F.lit(0)).when(risk >= 0.35, F.least(rank, F.lit(1))).otherwise(rank)
