"""JSON reports and console text, for one scan's matches on the driver."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sparql import Result
from ..vocab import PATTERNS, pattern_iri

TOOL, VERSION = "factloom", "1.0.0"


def match_json(reported: DataFrame) -> DataFrame:
    """(unit, pattern, match_id, match): each match as a JSON object without nulls."""
    role = lambda r: F.struct(r["role"].alias("role"), r["label"].alias("label"), r["file"].alias("file"), r["start_line"].alias("startLine"), r["end_line"].alias("endLine"), r["iri"].alias("iri"), r["fragment"].alias("fragment"))
    fields = [F.transform("roles", role).alias("roles")]
    if "verdict" in reported.columns:
        fields.append(F.col("verdict"))
    return reported.select("unit", "pattern", "match_id", F.to_json(F.struct(*fields)).alias("match"))


def scan_report(matches: DataFrame, files: int, errors: dict[str, str] | None = None) -> dict:
    """The report of one scan; a row of match_json for each match is brought to the driver, as the file is one."""
    by: dict[str, list] = {p: [] for p in PATTERNS}
    for r in matches.orderBy("pattern", "match_id").toLocalIterator():
        by[r.pattern].append(json.loads(r.match))
    patterns = [{k: v for k, v in {"pattern": p, "iri": pattern_iri(p), "matches": by[p]}.items() if v is not None} for p in PATTERNS]
    return {"tool": TOOL, "version": VERSION, "generatedAt": datetime.now(UTC).isoformat(), "fileCount": files, "patterns": patterns, "errors": [f"{p}: {e}" for p, e in sorted((errors or {}).items())]}


def console(report: dict) -> str:
    lines = []
    for p in report["patterns"]:
        for m in p["matches"]:
            verdict = m.get("verdict")
            tail = f" [{verdict['outcome']}: {verdict.get('rationale', '')}]" if verdict else ""
            lines.append(f"{p['pattern']}: " + ", ".join(f"{r['role']} = {r['label']}" for r in m["roles"]) + tail)
    lines += [f"failed: {e}" for e in report.get("errors", [])]
    if report.get("review"):
        lines.append(review_line(report["review"]))
    lines.append(f"{sum(len(p['matches']) for p in report['patterns'])} match(es) in {report['fileCount']} file(s).")
    return "\n".join(lines)


def table(headers: list[str], rows: list[list], signed: set[int] = frozenset()) -> str:
    """Fixed-width text; '-' for what is undefined, a sign before changes."""

    def cell(k, v):
        if v is None:
            return "-"
        if isinstance(v, float):
            return f"{v:+.3f}" if k in signed else f"{v:.3f}"
        return str(v)

    text = [[cell(k, v) for k, v in enumerate(r)] for r in rows]
    widths = [max([len(h), *(len(r[k]) for r in text)]) for k, h in enumerate(headers)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in [headers, *text])


#: Seconds from which a scan, and a query in it, are told as slow.
SLOW_SCAN, SLOW_QUERY = 10.0, 1.0


def review_line(tally: dict) -> str:
    told = ", ".join(f"{tally[k]} {k.replace('_', ' ')}" for k in ("reviewed", "confirmed", "uncertain", "rejected", "dropped", "unreviewed", "cache_hits"))
    tail = f"; first failure: {tally['failure']}" if tally.get("failure") else ""
    return f"Review by {tally.get('model') or tally.get('models')}: {told}, {tally['tokens_in']} tokens in, {tally['tokens_out']} out{tail}."


def evaluation_text(report: dict, baseline: dict | None = None) -> str:
    """What an evaluation prints: figures by pattern, with the change of F1 against a baseline, and what was slow."""
    before = {p["pattern"]: p.get("f1") for p in (baseline or {}).get("perPattern", [])}
    headers, rows = ["pattern", "TP", "FP", "FN", "P", "R", "F1"], []
    entries = [*report["perPattern"], {"pattern": "micro", **report["micro"]}, {"pattern": "macro", **report["macro"]}]
    before |= {k: (baseline or {}).get(k, {}).get("f1") for k in ("micro", "macro")}
    for p in entries:
        row = [p["pattern"], p.get("truePositives"), p.get("falsePositives"), p.get("falseNegatives"), p.get("precision"), p.get("recall"), p.get("f1")]
        if baseline is not None:
            was = before.get(p["pattern"])
            row.append(None if was is None or p.get("f1") is None else float(p["f1"] - was))
        rows.append(row)
    lines = [table(headers + (["change"] if baseline is not None else []), rows, {7})]
    lines += [f"{c['corpus']} at commit {c['commit']}" for c in [report, *report.get("corpora", [])] if c.get("commit")]
    if report["detectionSeconds"] >= SLOW_SCAN:
        lines += [f"slow: {x['pattern']} {x['seconds']:.1f} s" for x in report.get("slowest", []) if x["seconds"] >= SLOW_QUERY]
    if report.get("review"):
        lines.append(review_line(report["review"]))
    return "\n".join([*lines, *(f"failed: {e}" for e in report.get("errors", []))])


def query_text(result: Result) -> str:
    """A query's result: `v = x` lines and a count, true or false, or Turtle."""
    if result.form == "ask":
        return "\n".join(str(r.answer).lower() for r in result.table.orderBy("unit").toLocalIterator())
    if result.form == "select":
        lines = [", ".join(f"{v} = {r[v]}" for v in result.variables if r[v] is not None) for r in result.table.toLocalIterator()]
        return "\n".join([*lines, f"{len(lines)} row(s)."])
    from .turtle import subjects

    return "\n".join(r.turtle for r in subjects(result.table).orderBy("unit", "s").toLocalIterator())
