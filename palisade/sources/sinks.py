"""Audit records, metric text and reports."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

FIELDS = ["request_id", "agent_id", "role", "source", "tool", "verdict", "allowed", "executed", "tier", "injection_score", "anomaly_score", "exfiltration_attempt", "exfiltration_blocked", "error", "latency_ms", "reasons"]


def audit(decisions: DataFrame) -> DataFrame:
    """(severity, 16 fields, record): one JSON record for each decision."""
    severity = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("verdict").isin("block", "quarantine") | F.col("exfiltration_attempt"), "WARNING").otherwise("INFO")
    df = decisions if "latency_ms" in decisions.columns else decisions.withColumn("latency_ms", F.lit(None).cast("double"))
    df = df.withColumns({"injection_score": F.round("injection_score", 4), "anomaly_score": F.round("anomaly_score", 4), "latency_ms": F.round("latency_ms", 3)})
    return df.select(severity.alias("severity"), *FIELDS, F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("record"))


def write_audit(decisions: DataFrame, path: str) -> None:
    """Append JSON lines below path."""
    audit(decisions).drop("record").write.mode("append").json(path)


def prometheus(counts: DataFrame, latency: DataFrame | None = None, prefix: str = "palisade") -> str:
    """The text exposition of counters (key, n) and stage latencies; both tables are a few rows."""
    name = lambda s: re.sub(r"[^a-zA-Z0-9_]", "_", s)
    out, typed = [], set()

    def kind(metric, what):
        if metric not in typed:
            typed.add(metric)
            out.append(f"# TYPE {metric} {what}")

    for r in counts.orderBy("key").collect():
        family, _, label = r["key"].partition(".")
        metric = f"{prefix}_{name(family)}_total"
        kind(metric, "counter")
        out.append(f'{metric}{{{name(family)}="{label}"}} {r["n"]}' if label else f"{metric} {r['n']}")
    for r in latency.orderBy(latency.columns[0]).collect() if latency is not None else ():
        metric = f"{prefix}_stage_latency_ms"
        kind(metric, "gauge")
        out += [f'{metric}{{stage="{name(r[0])}",quantile="{q}"}} {r[q]:.4f}' for q in ("p50", "p95", "p99")]
        out.append(f'{prefix}_stage_observations_total{{stage="{name(r[0])}"}} {r["count"]}')
    return "\n".join(out) + "\n"


def summary(decision: dict) -> str:
    """One line about a decision."""
    return f"{decision['verdict']} tier={decision['tier'] or '-'} inj={decision['injection_score']:.2f} anom={decision['anomaly_score']:.2f} executed={decision['executed']}"


def write_report(results: dict, folder: str | Path) -> None:
    """results.json and RESULTS.md, each replaced whole."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    table = "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(results.items()))])
    for file, text in (("results.json", json.dumps(results, indent=2, sort_keys=True)), ("RESULTS.md", f"# Results\n\n{table}\n")):
        tmp = folder / f".{file}.tmp"
        tmp.write_text(text)
        os.replace(tmp, folder / file)
