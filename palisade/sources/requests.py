"""Requests from message lists, JSON bodies and tool-call streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import ARGS

#: Longest JSON body, in bytes.
MAX_BODY = 256 * 1024
BODY = "agent_id string, role string, content string, source string, tool string, args map<string,string>"


def from_messages(messages: DataFrame, roles=("user", "tool")) -> DataFrame:
    """(conv_id, turn, role, text, context): the latest message of the given roles up to each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("role").isin(*roles), F.col("text")), ignorenulls=True).over(w)
    return messages.select("conv_id", "turn", "role", "text", F.coalesce(latest, F.lit("")).alias("context"))


def from_json(bodies: DataFrame, column: str, key: str) -> DataFrame:
    """Requests from JSON bodies; ``error`` tells of bodies that are too long or malformed.

    Arguments of a JSON object keep their order.
    """
    body = F.col(column)
    fits = F.octet_length(body) <= MAX_BODY
    parsed = F.from_json(F.when(fits, body), BODY + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = bodies.select(F.col(key).alias("request_id"), body.alias("_body"), fits.alias("_fits"), parsed.alias("_r"))
    args = F.transform(F.map_entries("_r.args"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))).cast(ARGS)
    error = F.when(F.col("_body").isNull(), "empty body").when(~F.col("_fits"), "body too large").when(F.col("_r._bad").isNotNull(), "malformed body")
    return df.select("request_id", "_r.agent_id", "_r.role", F.coalesce("_r.content", F.lit("")).alias("content"), F.coalesce("_r.source", F.lit("user")).alias("source"), "_r.tool", F.coalesce(args, F.array().cast(ARGS)).alias("args"), error.alias("error"))
