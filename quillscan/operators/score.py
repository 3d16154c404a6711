"""Scores, summaries, assessments and file metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions import text
from quillscan.operators.rules import PENALTY, SEVERITIES


def penalty(severity: Column) -> Column:
    return text.lookup(severity, PENALTY)


def severity_score(severity: Column) -> Column:
    return text.lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def file_results(files: DataFrame, detections: DataFrame) -> DataFrame:
    """(path, language, issues, criticals, score); a file without detections has 100."""
    sums = detections.groupBy("path").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "Critical").alias("criticals"), F.sum(penalty(F.col("severity"))).alias("lost"))
    rows = files.select("path", "language").join(sums, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("path", "language", zero(F.col("issues")).alias("issues"), zero(F.col("criticals")).alias("criticals"), F.greatest(F.lit(0.0), 100.0 - F.coalesce("lost", F.lit(0))).alias("score"))


def summary(results: DataFrame) -> DataFrame:
    """One row: total_files, total_detections, critical_issues, average_quality_score (100 without files)."""
    return results.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("issues"), F.lit(0)).alias("total_detections"), F.coalesce(F.sum("criticals"), F.lit(0)).alias("critical_issues"), F.coalesce(F.avg("score"), F.lit(100.0)).alias("average_quality_score"))


def assessment(detections: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, maintainability, reliability, performance, security, completeness, overall). With files, also of those without detections."""
    sev, rule = F.col("severity"), F.col("rule_id")
    loss = lambda *cases: F.sum(sum((F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in cases), F.lit(0.0)))
    critical, high, medium = sev == "Critical", sev == "High", sev == "Medium"
    unimplemented, panic = rule.contains("unimplemented"), rule.contains("panic")
    unwrap, security, todo = rule.contains("unwrap"), rule.contains("security"), rule.contains("todo")
    rows = detections.groupBy("path").agg(
        loss((medium & ~todo, 5.0), (sev == "Low", 2.0), (sev == "Info", 0.5)).alias("m"),
        loss((critical & ~unimplemented & panic, 20.0), (critical & ~unimplemented & ~panic, 15.0), (high & unwrap, 10.0), (high & ~unwrap & ~security, 8.0)).alias("r"),
        loss((high & ~unwrap & security, 15.0)).alias("s"),
        loss((critical & unimplemented, 25.0), (medium & todo, 5.0)).alias("c"),
    )
    if files is not None:
        rows = files.select("path").join(rows, "path", "left").fillna(0.0, ["m", "r", "s", "c"])
    left = lambda c: F.greatest(F.lit(0.0), 100.0 - F.col(c))
    rows = rows.select("path", left("m").alias("maintainability"), left("r").alias("reliability"), F.lit(100.0).alias("performance"), left("s").alias("security"), left("c").alias("completeness"))
    overall = F.col("maintainability") * 0.25 + F.col("reliability") * 0.30 + F.col("performance") * 0.20 + F.col("security") * 0.15 + F.col("completeness") * 0.10
    return rows.withColumn("overall", overall)


def full_assessment(detections: DataFrame, metrics: DataFrame) -> DataFrame:
    """assessment() less what complexity, memory and concurrency cost.

    metrics (per file, from outside): path, cyclomatic, cognitive, npath, halstead, and where there are such columns
    average_complexity, loop_depths (array<int>), allocation_hotspots, leak_risks, synchronization_issues, thread_safety_concerns.
    """
    step = lambda c, *limits: sum((F.when(F.col(c) > at, F.lit(v)).otherwise(F.lit(0.0)) for at, v in limits), F.lit(0.0))
    rows = metrics.join(assessment(detections), "path", "left")
    held = {c: F.coalesce(F.col(c), F.lit(100.0)) for c in ("maintainability", "reliability", "performance", "security", "completeness")}
    held["maintainability"] = held["maintainability"] - step("cyclomatic", (10, 8.0), (20, 7.0)) - step("cognitive", (15, 6.0), (25, 6.0)) - step("npath", (1000, 10.0)) - step("halstead", (50, 8.0))
    held["performance"] = held["performance"] - step("npath", (1000, 5.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in metrics.columns else F.lit(0)
    if "average_complexity" in metrics.columns:
        held["maintainability"] = held["maintainability"] - step("average_complexity", (15, 10.0), (20, 5.0))
        held["performance"] = held["performance"] - step("average_complexity", (15, 5.0), (20, 5.0))
    if "loop_depths" in metrics.columns:
        loops = lambda deep, very: F.aggregate(F.coalesce("loop_depths", F.array().cast("array<int>")), F.lit(0.0), lambda s, d: s + F.when(d > 4, very).when(d > 3, deep).otherwise(0.0))
        held["maintainability"] = held["maintainability"] - loops(5.0, 10.0)
        held["performance"] = held["performance"] - loops(10.0, 20.0)
    held["performance"] = held["performance"] - 2.0 * count("allocation_hotspots")
    held["reliability"] = held["reliability"] - 10.0 * count("leak_risks") - 15.0 * count("synchronization_issues")
    held["security"] = held["security"] - 10.0 * count("thread_safety_concerns")
    rows = rows.select("path", *[F.greatest(F.lit(0.0), v).alias(c) for c, v in held.items()])
    return rows.withColumn("overall", F.col("maintainability") * 0.25 + F.col("reliability") * 0.30 + F.col("performance") * 0.20 + F.col("security") * 0.15 + F.col("completeness") * 0.10)


def impact(rule_id: Column) -> Column:
    """How much a rule's findings cost at run time."""
    return F.when(rule_id.contains("unimplemented"), "High").when(rule_id.contains("unwrap"), "Medium").when(rule_id.contains("panic"), "High").when(rule_id.contains("todo"), "Low").otherwise("Low")


def metrics(files: DataFrame) -> DataFrame:
    """(path, line_count, char_count, file_size_bytes, cyclomatic_complexity, nesting_depth, function_count, comment_ratio)."""
    rows = files.select("path", "content", text.lines(F.col("content")).alias("rows"))
    trimmed = F.transform("rows", text.trim_ws)
    functions = lambda x: x.contains("fn ") | x.contains("def ") | x.contains("function ") | (x.contains("(") & x.contains(")") & x.contains("{"))
    rows = rows.withColumn("trimmed", trimmed)
    filled = F.size(F.filter("trimmed", lambda x: x != ""))
    comments = F.size(F.filter("trimmed", lambda x: x.rlike(r"^(//|#|/\*)")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def line_end(a: Column, x: Column) -> Column:
        # only brackets matter; the depth stays at 0 where more are closed than open
        signs = F.split(F.regexp_replace(x, r"[^\[\](){}]", ""), "")
        depth = F.aggregate(signs, a["depth"], lambda d, c: F.when(c.isin("{", "(", "["), d + 1).when(c.isin("}", ")", "]"), F.greatest(d - 1, F.lit(0))).otherwise(d))
        return F.transform(F.array(depth), lambda d: F.struct(d.alias("depth"), F.greatest(a["most"], d).alias("most")))[0]

    deepest = F.aggregate("rows", start, line_end, lambda a: a["most"])
    return rows.select(
        "path",
        F.size("rows").cast("long").alias("line_count"),
        F.length("content").cast("long").alias("char_count"),
        F.octet_length("content").cast("long").alias("file_size_bytes"),
        F.lit(1).cast("long").alias("cyclomatic_complexity"),
        deepest.cast("long").alias("nesting_depth"),
        F.size(F.filter("trimmed", functions)).cast("long").alias("function_count"),
        F.when(filled > 0, comments / filled).otherwise(F.lit(0.0)).alias("comment_ratio"),
    )


def first_per_file(detections: DataFrame, n: int = 3) -> DataFrame:
    """The first n detections of each file in order of emission, and how many more there are."""
    order = Window.partitionBy("path").orderBy("seq", "line_no", "column", "context")
    rows = detections.withColumns({"rn": F.row_number().over(order), "more": F.greatest(F.count("*").over(Window.partitionBy("path")) - n, F.lit(0))})
    return rows.where(F.col("rn") <= n)


def most_severe(detections: DataFrame) -> DataFrame:
    """The most severe detection of each file, the last of equals."""
    return detections.groupBy("path").agg(F.max_by(F.struct("rule_id", "severity", "line_no"), F.struct(severity_score(F.col("severity")), "seq", "line_no", "column")).alias("worst")).select("path", "worst.*")


def severity_counts(detections: DataFrame, *by: str) -> DataFrame:
    return detections.groupBy(*(by or ("severity",))).agg(F.count("*").alias("n"))


def enhanced(detections: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """assessment() with performance_score (from scores: path, performance_score; else 100) and recommendations by impact."""
    advice = detections.groupBy("path").agg(F.sort_array(F.collect_set(F.concat_ws(": ", impact(F.col("rule_id")), "rule_id"))).alias("recommendations"))
    rows = assessment(detections).join(advice, "path")
    if scores is not None:
        return rows.join(scores, "path", "left").withColumn("performance_score", F.coalesce("performance_score", F.lit(100)))
    return rows.withColumn("performance_score", F.lit(100))


def recommendations(metrics: DataFrame) -> DataFrame:
    """(path, recommendations array<string>) from the same metrics as full_assessment() takes, those that are there."""
    deep = F.size(F.filter(F.coalesce("loop_depths", F.array().cast("array<int>")), lambda d: d > 3)) if "loop_depths" in metrics.columns else F.lit(0)
    cases = [
        ("average_complexity", lambda c: c > 15, "complexity %.1f on average: split what is complex", "double"),
        ("allocation_hotspots", lambda c: c > 0, "%d places allocate much: look at memory use", "int"),
        ("leak_risks", lambda c: c > 0, "%d risks of leaked memory", "int"),
        ("thread_safety_concerns", lambda c: c > 0, "%d concerns of thread safety", "int"),
    ]
    found = [F.when(test(F.col(c)), F.format_string(text_, F.col(c).cast(kind))) for c, test, text_, kind in cases if c in metrics.columns]
    return metrics.select("path", F.array_compact(F.array(*found, F.when(deep > 0, F.format_string("%d loops nested more than 3 deep", deep)))).alias("recommendations"))


def severe_counts(detections: DataFrame) -> DataFrame:
    """(path, criticals, highs) of files with detections."""
    return detections.groupBy("path").agg(F.count_if(F.col("severity") == "Critical").alias("criticals"), F.count_if(F.col("severity") == "High").alias("highs"))


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """(path, n_functions, n_types, functions array<string>): different names, in order."""
    function = F.col("kind").isin("function", "method")
    return symbols.groupBy("path").agg(F.count_if(function).alias("n_functions"), F.count_if(~function).alias("n_types"), F.array_sort(F.collect_set(F.when(function, F.col("name")))).alias("functions"))


def semantic_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_summary() of all files, with n_validations: lines that check, validate, verify or assert something. Taint flows are the external analyser's and have no part here."""
    lines = text.lines(F.col("content"))
    checks = F.size(F.filter(lines, lambda x: F.lower(x).rlike(r"\b(check|validate|verify|assert)\w*\b")))
    rows = files.select("path", checks.cast("long").alias("n_validations")).join(symbol_summary(symbols), "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("path", zero("n_functions"), zero("n_types"), F.coalesce("functions", F.array().cast("array<string>")).alias("functions"), "n_validations")


def run_trend(runs: DataFrame, by: str = "path", at: str = "run_ts", value: str = "score") -> DataFrame:
    """runs with before, the value of the run before of the same file, and change."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(at))
    return runs.withColumn("before", before).withColumn("change", F.col(value) - F.col("before"))
