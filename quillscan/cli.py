"""Command line: analyze-files, checkpoint, patterns, verify-todo."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from quillscan.functions.text import BY_EXTENSION
from quillscan.operators import control, match, report, rules, score
from quillscan.sources import files as src


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillscan")
    top.add_argument("-v", action="count", default=0)
    sub = top.add_subparsers(dest="command", required=True)
    formats = ["table", "json", "markdown", "compact"]
    a = sub.add_parser("analyze-files")
    a.add_argument("paths", nargs="+")
    a.add_argument("-f", "--format", choices=formats, default="table")
    a.add_argument("-d", "--detailed", action="store_true")
    for flag in ("--include-hidden", "--include-tests"):
        a.add_argument(flag, action="store_true")
    for option in ("--extensions", "--exclude", "--force-language", "--output-file", "--checkpoint", "--diff-checkpoint"):
        a.add_argument(option)
    a.add_argument("--max-file-size-mb", type=float, default=10)
    a.add_argument("--test-confidence", type=float, default=0.3)
    c = sub.add_parser("checkpoint").add_subparsers(dest="action", required=True)
    p = c.add_parser("create")
    p.add_argument("-n", "--name", required=True)
    p.add_argument("-d", "--description")
    p.add_argument("paths", nargs="+")
    c.add_parser("list").add_argument("-f", "--format", choices=formats, default="table")
    c.add_parser("show").add_argument("name")
    p = c.add_parser("diff")
    p.add_argument("checkpoint")
    p.add_argument("paths", nargs="*")
    p.add_argument("-f", "--format", choices=formats, default="table")
    p = c.add_parser("delete")
    p.add_argument("name")
    p.add_argument("--confirm", action="store_true")
    t = sub.add_parser("patterns").add_subparsers(dest="action", required=True)
    p = t.add_parser("create")
    for option in ("language", "name", "description", "pattern"):
        p.add_argument(f"--{option}", required=True)
    p.add_argument("--severity", default="medium")
    p.add_argument("--scope", default="function_body")
    p.add_argument("--confidence", type=float, default=0.8)
    for name in ("list", "stats", "export", "validate", "init"):
        p = t.add_parser(name)
        p.add_argument("--language")
        p.add_argument("--output")
    p = t.add_parser("delete")
    p.add_argument("pattern_id")
    p.add_argument("--confirm", action="store_true")
    g = sub.add_parser("verify-todo")
    g.add_argument("-t", "--todo-id", required=True)
    g.add_argument("-f", "--files", nargs="*", default=[])
    g.add_argument("--min-quality-score", type=float, default=80)
    g.add_argument("--max-critical-issues", type=int, default=0)
    g.add_argument("--format", choices=formats, default="table")
    g.add_argument("--policy", choices=["git", "reported"], default="git")
    g.add_argument("--include-tests", action="store_true")
    g.add_argument("--strict", action="store_true", help="a quality of 85 and no critical issue")
    return top


def main(argv: list[str] | None = None, base: str = ".quillscan") -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    base = os.path.abspath(base)  # Spark's own working folder can be another one
    store, points = control.LearnedRules(base), control.Checkpoints(spark, f"{base}/checkpoints")
    if args.command == "analyze-files":
        return analyze(args, spark, points)
    if args.command == "checkpoint":
        if args.action == "create":
            print(f">> Checkpoint '{args.name}' created with {points.create(args.name, src.hashed(spark, args.paths), args.description)} files")
        elif args.action == "list":
            print(json.dumps(points.list(), indent=2) if args.format == "json" else "\n".join(f"{x['name']}: {x['file_count']} files ({x['timestamp'][:16]})" for x in points.list()) or "[INFO] No checkpoints found")
        elif args.action == "show":
            print(points.get(args.name), *[f"  {r['path']} ({r['size']})" for r in points.files(args.name).toLocalIterator()], sep="\n")
        elif args.action == "diff":
            print(report.diff_text(points.compare(args.checkpoint, src.hashed(spark, args.paths or ["."])), args.checkpoint, args.format))
        else:
            print(f">> Checkpoint '{args.name}' deleted" if points.delete(args.name, args.confirm) else "Checkpoint deletion requires --confirm flag for safety")
        return 0
    if args.command == "patterns":
        return patterns(args, spark, store)
    return verify(args, spark, store)


def verify(args, spark: SparkSession, store: control.LearnedRules) -> int:
    """The gate over changed (or reported) files, test files left out; warns of changed files that were not reported."""
    from pyspark.sql import functions as F

    from quillscan.functions import classify

    warn = lambda m: print(m, file=sys.stderr)
    if args.strict:
        args.min_quality_score, args.max_critical_issues = control.STRICT["min_quality"], control.STRICT["max_critical"]
    reported = spark.createDataFrame([(f,) for f in args.files], "path string")
    changed = src.git_changes(spark)
    hidden = [r["path"] for r in control.hidden_files(changed, reported).orderBy("path").collect()] if args.files else []
    if hidden:
        warn(f"{len(hidden)} changed files were not reported: {', '.join(hidden)}")
    paths = [r["path"] for r in control.gate_files(changed, reported, args.policy).collect()]
    held = store.rules(rules.LANGUAGES, warn) + rules.load_playbooks("playbooks", warn=warn)
    data = src.read(spark, paths)
    if not args.include_tests:
        test = classify.combined(classify.path_part(F.col("path")), classify.content_part(F.col("content"), F.col("path")))
        data = data.where(test["confidence"] < 0.3)
    found = match.detect(data, held, symbols=src.symbols(data)) if held else spark.createDataFrame([], "path string, seq int, rule_id string, rule_name string, severity string, line_no int, column int, snippet string, context string")
    results = score.file_results(data, found)
    row = control.gate(score.summary(results), args.min_quality_score, args.max_critical_issues).first()
    if args.format == "json":
        print(report.gate_json(args.todo_id, row, args.min_quality_score, args.max_critical_issues, report.as_json(results, found)))
    else:
        print(report.gate_text(args.todo_id, row, args.min_quality_score, args.max_critical_issues, score.first_per_file(found)))
    return 0 if row["passed"] else 1


def analyze(args, spark: SparkSession, points: control.Checkpoints) -> int:
    from pyspark.sql import functions as F

    from quillscan.functions import classify

    forced = args.force_language if args.force_language in BY_EXTENSION.values() else None
    if args.force_language and not forced:
        print(f"unknown language {args.force_language}: languages are told by extension", file=sys.stderr)
    data = src.read(spark, args.paths, include_hidden=args.include_hidden, extensions=args.extensions.split(",") if args.extensions else None, exclude=[args.exclude] if args.exclude else [], max_bytes=int(args.max_file_size_mb * 1024 * 1024))
    if not args.include_tests:
        test = classify.combined(classify.path_part(F.col("path")), classify.content_part(F.col("content"), F.col("path")))
        data = data.where(test["confidence"] < args.test_confidence)
    changes = None
    if args.diff_checkpoint:
        change = points.compare(args.diff_checkpoint, src.hashed(spark, args.paths))
        counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        changes = {k: counts.get(k, 0) for k in ("new", "changed", "deleted")}
        data = control.changed_files(data, change)
    found = match.detect(data, rules.packs(), symbols=src.symbols(data))
    results = score.file_results(data, found)
    if forced:
        results = results.withColumn("language", F.lit(forced))
    detections = found if args.detailed else None
    if args.format == "json":
        out = json.dumps(json.loads(report.envelope(results, found).first()["json"]), indent=2, ensure_ascii=False)
    elif args.format == "compact":
        out = "\n".join(r["line"] for r in report.compact(results).orderBy("path").toLocalIterator())
    else:
        out = report.markdown(results, detections) if args.format == "markdown" else report.table(results, detections, changes)
    if args.output_file:
        with open(args.output_file, "w", encoding="utf-8") as f:
            f.write(out + "\n")
    else:
        print(out)
    if args.checkpoint:
        points.create(args.checkpoint, src.hashed(spark, args.paths))
    return 0


def patterns(args, spark: SparkSession, store: control.LearnedRules) -> int:
    languages = [args.language] if getattr(args, "language", None) else list(rules.LANGUAGES)
    if args.action == "create":
        scope = "".join(x.capitalize() for x in args.scope.split("_"))
        got = store.create(rules.Rule("", args.name, args.severity.capitalize(), scope, args.pattern, args.language, "learned", description=args.description), args.confidence)
        print(got)
        return 0 if got["success"] else 1
    if args.action == "init":
        store.bootstrap()
    elif args.action == "delete":
        if not args.confirm:
            print("Deletion requires --confirm")
            return 1
        return 0 if any(store.delete(lang, args.pattern_id) for lang in languages) else 1
    elif args.action == "stats":
        control.learned_stats(store.table(spark, languages)).show(truncate=False)
    elif args.action == "export":
        for lang in languages:
            if held := store.playbook(lang):
                rules.dump_playbook(held, f"Learned {lang}", lang, args.output or f"learned-{lang}.yaml")
    elif args.action == "validate":
        bad = [(r.id, e) for lang in languages for r in store.playbook(lang) or [] for e in store.check(r)[0]]
        print(bad)
        return 1 if bad else 0
    else:
        store.table(spark, languages).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
