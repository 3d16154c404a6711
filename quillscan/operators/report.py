"""Reports: table, JSON, Markdown, compact, gate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import score

ICONS = {"Critical": "[!!]", "High": "[!]", "Medium": "[*]", "Low": "[-]", "Info": "[i]"}


def compact(results: DataFrame) -> DataFrame:
    """(path, line): one line for each file with detections."""
    return results.where("issues > 0").select("path", F.format_string("%s: %d issues, %.1f%% quality", "path", "issues", "score").alias("line"))


def as_json(results: DataFrame, detections: DataFrame) -> DataFrame:
    """(path, json) of each file's result."""
    held = detections.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "line_no", "column", "rule_id", "rule_name", "severity", "snippet", "context"))).alias("detections"))
    rows = results.join(held, "path", "left")
    return rows.select("path", F.to_json(F.struct(F.col("path").alias("file_path"), "language", F.col("score").alias("quality_score"), "detections")).alias("json"))


def envelope(results: DataFrame, detections: DataFrame) -> DataFrame:
    """(json): one row, the whole run: totals and every file's result. For reports; the results of a table are as_json()."""
    files = as_json(results, detections).agg(F.sort_array(F.collect_list(F.struct("path", "json"))).alias("f"))
    rows = score.summary(results).join(files)  # a row each
    body = F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("]"))
    totals = F.to_json(F.struct("total_files", "total_detections", "critical_issues", "average_quality_score"))
    return rows.select(totals.alias("t"), body.alias("b")).select(F.concat(F.expr("substring(t, 1, length(t) - 1)"), F.lit(',"file_results":'), F.col("b"), F.lit("}")).alias("json"))


def _rows(results: DataFrame, detections: DataFrame | None):
    """Files with detections, in order, one partition of results at a time, each with its detections."""
    files = results.where("issues > 0")
    if detections is not None:
        held = detections.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "line_no", "column", "severity", "rule_name", "snippet"))).alias("found"))
        files = files.join(held, "path", "left")
    return files.orderBy("path").toLocalIterator()


def table(results: DataFrame, detections: DataFrame | None = None, changes: dict | None = None) -> str:
    s = score.summary(results).first()
    out = [":: Standalone File Analysis Results", "═" * 39, ""]
    if changes:
        out += [">> Change Summary:", f"   New files: {changes['new']}", f"   Modified files: {changes['changed']}", f"   Deleted files: {changes['deleted']}", ""]
    out += [">> Analysis Summary:", f"   Files analyzed: {s['total_files']}", f"   Total patterns: {s['total_detections']}", f"   Critical issues: {s['critical_issues']}", f"   Average quality: {s['average_quality_score']:.1f}%", ""]
    if s["total_files"]:
        out.append(">> File Analysis:")
    for r in _rows(results, detections):
        out += [f"   {r['path']} ({r['language'] or 'unknown'})", f"      Issues: {r['issues']} | Quality: {r['score']:.1f}%"]
        out += [f"         {ICONS[d['severity']]} {d['rule_name']} ({r['path']}:{d['line_no']}): {d['snippet'].strip()}" for d in (r["found"] or [])] if detections is not None else []
        out.append("")
    if s["critical_issues"]:
        out.append(f"!! {s['critical_issues']} critical issues detected that require immediate attention")
    elif not s["total_detections"]:
        out.append(">> No issues detected! Code quality looks excellent.")
    return "\n".join(out)


def markdown(results: DataFrame, detections: DataFrame | None = None) -> str:
    s = score.summary(results).first()
    out = ["# Standalone File Analysis Results", "", "## Summary", "", "| Metric | Value |", "| ------ | ----- |", f"| Files analyzed | {s['total_files']} |", f"| Total patterns | {s['total_detections']} |", f"| Critical issues | {s['critical_issues']} |", f"| Average quality | {s['average_quality_score']:.1f}% |", ""]
    if s["total_files"]:
        out += ["## File Analysis", ""]
    for r in _rows(results, detections):
        out += [f"### `{r['path']}`", "", f"- **Language**: {r['language'] or 'unknown'}", f"- **Issues**: {r['issues']}", f"- **Quality**: {r['score']:.1f}%", ""]
        if detections is not None:
            out += ["#### Issues", "", *[f"- {ICONS[d['severity']]} **{d['rule_name']}** (line {d['line_no']}): `{d['snippet'].strip()}`" for d in (r["found"] or [])], ""]
    return "\n".join(out)


def gate_json(name: str, row, min_quality: float, max_critical: int, files: DataFrame) -> str:
    held = [json.loads(r["json"]) for r in files.toLocalIterator()]
    return json.dumps({"todo_id": name, "verification_passed": row["passed"], "quality_score": row["average_quality_score"], "min_quality_required": min_quality, "critical_issues": row["critical_issues"], "max_critical_allowed": max_critical, "analysis_results": {"total_files": row["total_files"], "total_detections": row["total_detections"], "critical_issues": row["critical_issues"], "average_quality_score": row["average_quality_score"], "file_results": held}}, indent=2)


def gate_text(name: str, row, min_quality: float, max_critical: int, first: DataFrame) -> str:
    out = ["TODO Verification Report", "─" * 50, f"├─ TODO: {name}", "├─ Metrics", f"│  ├─ Files analyzed: {row['total_files']}", f"│  ├─ Quality score: {row['average_quality_score']}% (required: {min_quality}%)", f"│  ├─ Critical issues: {row['critical_issues']} (max allowed: {max_critical})", f"│  └─ Total detections: {row['total_detections']}", "├─ Result"]
    if row["passed"]:
        return "\n".join([*out, "│  └─ ● PASSED - Ready to mark complete"])
    out.append("│  └─ ● FAILED - Continue working on this TODO")
    path = None
    for r in first.orderBy("path", "rn").toLocalIterator():
        if r["path"] != path:
            path = r["path"]
            out.append(f"   ├─ {path}")
        out.append(f"   │     ├─ ● {r['rule_name']} (line {r['line_no']}): {r['snippet'].strip()[:50]}")
        if r["rn"] == 3 and r["more"]:
            out.append(f"   │     └─ ● ... and {r['more']} more issues")
    return "\n".join(out)


def diff_text(changes: DataFrame, name: str, how: str = "table") -> str:
    found = {"new": [], "changed": [], "deleted": []}
    for r in changes.orderBy("path").toLocalIterator():
        found[r["change"]].append(r["path"])
    if how == "json":
        return json.dumps({f"{k}_files": v for k, v in found.items()}, indent=2)
    if how == "compact":
        return f"Changes: +{len(found['new'])} ~{len(found['changed'])} -{len(found['deleted'])}"
    out = [f"[DIFF] Changes since checkpoint '{name}'", "═" * 35, ""]
    for key, title, mark in (("new", "[NEW] New files", "+"), ("changed", "[MOD] Modified files", "~"), ("deleted", "[DEL] Deleted files", "-")):
        if found[key]:
            out += [f"{title} ({len(found[key])}): ", *[f"  {mark} {p}" for p in found[key]], ""]
    return "\n".join(out if any(found.values()) else [*out, ">> No changes detected since checkpoint"])
