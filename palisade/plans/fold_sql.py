"""The behaviour fold in DuckDB SQL: a recursive query that takes one step of every agent at a time.

It is written from the rules alone and shares no code with the operator, so that the two can be held
against each other.
"""

from __future__ import annotations

_EMPTY = "CAST([] AS DOUBLE[])"


def _first(*branches: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in branches) + f" ELSE {other} END"


def fold_sql(steps: str, enforce: bool) -> str:
    """One row for each of ``steps``: agent, n, the decision's columns.

    steps has agent, ts, request_id, tool, sens, policy, oversize, inj, clean, risky, base_rank, is_read and, by
    tier, the lists ok, attempt, leaked and held (why it does not run).
    """
    on = "true" if enforce else "false"
    # what is remembered at this time, if it is used at all
    now = """SELECT s.*, f.tools AS tools0, f.attempts AS attempts0, f.blocks AS blocks0, f.read_at AS read0, f.allowed AS allowed0, f.seen AS seen0,
        CASE WHEN s.ts - f.seen > 3600 THEN CAST([] AS VARCHAR[]) ELSE f.tools END AS tools1, CASE WHEN s.ts - f.seen > 3600 THEN CAST([] AS DOUBLE[]) ELSE f.attempts END AS attempts1,
        CASE WHEN s.ts - f.seen > 3600 THEN CAST([] AS DOUBLE[]) ELSE f.blocks END AS blocks1, CASE WHEN s.ts - f.seen > 3600 THEN NULL ELSE f.read_at END AS read1, CASE WHEN s.ts - f.seen > 3600 THEN 0 ELSE f.allowed END AS allowed1
        FROM fold f JOIN steps s ON s.agent = f.agent AND s.n = f.n + 1"""
    tried = f"SELECT *, policy = 'ok' AND NOT oversize AS judged, CASE WHEN policy = 'ok' AND NOT oversize THEN list_append(attempts1, ts)[-256:] ELSE attempts1 END AS attempts2 FROM ({now}) a1"
    counted = f"SELECT *, len(list_filter(attempts2, lambda x: ts - x <= 1.0)) AS lately, len(list_filter(blocks1, lambda x: ts - x <= 60.0)) AS blocked FROM ({tried}) a2"
    signs = [
        "CASE WHEN lately > 20 THEN least(CAST(0.6 AS DOUBLE), CAST(0.3 AS DOUBLE) + CAST(0.3 AS DOUBLE) * (lately - 20) / 20) ELSE CAST(0 AS DOUBLE) END",
        "CASE WHEN allowed1 >= 3 AND NOT list_contains(tools1, tool) THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "CASE WHEN risky AND coalesce(ts - read1 <= 300.0, false) THEN CAST(0.7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "CASE WHEN sens = 'critical' AND allowed1 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        "least(CAST(0.5 AS DOUBLE), CAST(0.2 AS DOUBLE) * blocked)",
    ]
    usual = " * ".join(f"(CAST(1 AS DOUBLE) - {x})" for x in signs)
    scored = f"SELECT *, CASE WHEN judged THEN 1 - {usual} ELSE CAST(0 AS DOUBLE) END AS anomaly FROM ({counted}) a3"
    high = "sens IN ('high', 'critical')"
    by_text = _first(("inj >= 0.8", "'block'"), ("inj >= 0.3", "'sanitize'"), other="'allow'")
    found = _first(
        ("oversize", "'block'"), ("tool IS NULL", by_text), ("policy = 'hard'", "'block'"), ("policy = 'soft'", "'quarantine'"), (f"inj >= 0.8 OR ({high} AND inj >= 0.3) OR ({high} AND anomaly >= 0.85)", "'block'"),
        ("anomaly >= 0.55", "'quarantine'"), other="CASE WHEN inj >= 0.3 THEN 'sanitize' ELSE 'allow' END",
    )
    judged = f"SELECT *, {found} AS found FROM ({scored}) a4"
    first = f"CASE WHEN oversize THEN 'block' WHEN found = 'block' AND NOT {on} THEN 'allow' WHEN found = 'sanitize' AND clean THEN 'allow' WHEN found = 'sanitize' AND {on} THEN 'block' WHEN found = 'sanitize' THEN 'allow' ELSE found END"
    routed = f"""SELECT *, {first} AS first, found = 'sanitize' AS scrubbed, found = 'block' OR (found = 'sanitize' AND NOT clean) AS would1, found = 'quarantine' AS forced,
        1 - (1 - inj) * (1 - anomaly) AS risk FROM ({judged}) a5"""
    placed = f"SELECT *, CASE WHEN forced OR risk >= 0.6 THEN 0 WHEN risk >= 0.35 THEN least(base_rank, 1) ELSE base_rank END AS rank, first <> 'block' AND tool IS NOT NULL AS runs FROM ({routed}) a6"
    run = f"SELECT *, runs AND ok[rank + 1] AS ran, runs AND attempt[rank + 1] AS tried, runs AND leaked[rank + 1] AS leak FROM ({placed}) a7"
    said = [
        "lately || ' calls within 1 seconds'", "'never used ''' || tool || ''' before'", "'sends data out shortly after a sensitive read'",
        "'begins with a critical tool'", "'blocked ' || blocked || ' times shortly before'",
    ]
    seen = "list_filter([" + ", ".join(f"CASE WHEN {w} > 0 THEN {x} END" for w, x in zip(signs, said)) + "], lambda x: x IS NOT NULL)"
    opening = _first(
        ("oversize", "['oversize input is blocked']"), ("tool IS NULL", "['no tool call: ' || found]"), ("policy = 'hard'", "['policy forbids the call']"),
        ("policy = 'soft'", "['trust below the floor']"), other=seen,
    )
    later = [
        (f"found = 'block' AND NOT {on} AND NOT oversize", "'monitor only: would block'"), ("found = 'sanitize' AND NOT clean", "'injection is still there after scrubbing'"),
        ("runs AND NOT ran", "held[rank + 1]"),
    ]
    why = f"list_concat({opening}, list_filter([{', '.join(f'CASE WHEN {c} THEN {x} END' for c, x in later)}], lambda x: x IS NOT NULL))"
    ended = f"SELECT *, {why} AS why, CASE WHEN runs AND NOT ran AND first <> 'quarantine' THEN 'block' ELSE first END AS verdict FROM ({run}) a8"
    used = f"SELECT *, judged OR ran OR (verdict = 'block' AND tool IS NOT NULL) AS used, verdict = 'block' AND tool IS NOT NULL AS stops FROM ({ended}) a9"
    state = {
        "tools": "CASE WHEN ran AND verdict = 'allow' AND NOT list_contains(tools1, tool) THEN list_append(tools1, tool) ELSE tools1 END", "attempts": "attempts2",
        "blocks": "CASE WHEN stops THEN list_append(blocks1, ts)[-64:] ELSE blocks1 END", "read_at": "CASE WHEN ran AND verdict <> 'block' AND is_read THEN ts ELSE read1 END",
        "allowed": "CASE WHEN ran AND verdict = 'allow' THEN allowed1 + 1 ELSE allowed1 END", "seen": "ts",
    }
    old = {"tools": "tools0", "attempts": "attempts0", "blocks": "blocks0", "read_at": "read0", "allowed": "allowed0", "seen": "seen0"}
    after = ", ".join(f"CASE WHEN used THEN {v} ELSE {old[k]} END AS {k}" for k, v in state.items())
    outs = "request_id, verdict, CASE WHEN tool IS NULL THEN verdict <> 'block' ELSE ran END AS allowed_, ran, CASE WHEN runs THEN rank END AS tier_rank, anomaly, would1 OR tried AS would_block, tried, leak, scrubbed, why"
    start = f"SELECT DISTINCT agent, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS tools, {_EMPTY} AS attempts, {_EMPTY} AS blocks, CAST(NULL AS DOUBLE) AS read_at, CAST(0 AS BIGINT) AS allowed, CAST(NULL AS DOUBLE) AS seen"
    none = "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR[])"
    return f"""WITH RECURSIVE steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts, request_id) AS n FROM ({steps}) s0),
    fold(agent, n, tools, attempts, blocks, read_at, allowed, seen, request_id, verdict, allowed_, ran, tier_rank, anomaly, would_block, tried, leak, scrubbed, why) AS (
      {start}, {none} FROM steps
      UNION ALL
      SELECT agent, n, {after}, {outs} FROM ({used}) a10)
    SELECT s.*, f.verdict, f.allowed_, f.ran, f.tier_rank, f.anomaly, f.would_block, f.tried, f.leak, f.scrubbed, f.why FROM fold f JOIN steps s ON s.agent = f.agent AND s.n = f.n"""
