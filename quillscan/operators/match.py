"""Rule matching as column expressions: lines of each file against the rules of its language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import classify, text
from quillscan.operators.rules import Rule, dialect, executable

SYMBOLS = {"FunctionBody": ("function", "method"), "MethodSignature": ("function", "method"), "ClassBody": ("class", "struct")}
DETECTIONS = ("path", "seq", "rule_id", "rule_name", "severity", "line_no", "column", "snippet", "context")


def _hits(line: Column, rules: list[tuple[int, Rule]], whole: bool, honor_flags: bool) -> Column:
    """array<struct<seq, m>> of the rules that match; a rule's regular expression runs only where its literal is."""
    none = F.array().cast("array<string>")
    out = []
    for seq, r in rules:
        m = F.regexp_extract_all(line, F.lit(dialect(r, whole, honor_flags)), F.lit(0))
        out.append(F.struct(F.lit(seq).alias("seq"), (F.when(line.contains(r.guard), m).otherwise(none) if r.guard and not honor_flags else m).alias("m")))
    return F.filter(F.array(*out), lambda x: F.size(x["m"]) > 0) if out else F.array().cast("array<struct<seq:int,m:array<string>>>")


def _located(rows: DataFrame, column: str, rules: Sequence[Rule], whole: bool, honor_flags: bool, *keep: str) -> DataFrame:
    """A row for each match: snippet, the lines before it in the text, and the place of its first byte (whole: character) in its line, from 1. Lengths are added up once for all matches of a rule."""
    named = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, dialect(r, whole, honor_flags))])
    found = F.col("hit.m")
    pieces = F.slice(F.split(F.col(column), named[F.col("hit.seq")], -1), F.lit(1), F.size(found))
    size = F.length if whole else F.octet_length
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("at"), F.array().cast("array<struct<snippet:string,lines:int,at:int>>").alias("out"))

    def moved(lines: Column, at: Column, x: Column) -> tuple[Column, Column]:
        if not whole:
            return lines, at + size(x)
        n = F.regexp_count(x, F.lit("\n"))
        return lines + n, F.when(n > 0, F.length(F.substring_index(x, "\n", -1))).otherwise(at + F.length(x))

    def step(a: Column, x: Column) -> Column:
        lines, at = moved(a["lines"], a["at"], x["p"])

        def with_match(b: Column) -> Column:
            after, then = moved(b["lines"], b["at"], x["m"])
            return F.struct(after.alias("lines"), then.alias("at"), F.array_append(a["out"], F.struct(x["m"].alias("snippet"), b["lines"].alias("lines"), b["at"].alias("at"))).alias("out"))

        return F.transform(F.array(F.struct(lines.alias("lines"), at.alias("at"))), with_match)[0]

    zipped = F.arrays_zip(pieces.alias("p"), found.alias("m"))
    rows = rows.select(*keep, F.col("hit.seq").alias("seq"), F.explode(F.aggregate(zipped, start, step, lambda a: a["out"])).alias("x"))
    return rows.select(*keep, "seq", "x.snippet", "x.lines", (F.col("x.at") + 1).alias("column"))


def _named(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    pick = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("seq") + 1)
    return rows.withColumns({"rule_id": pick(lambda r: r.id), "rule_name": pick(lambda r: r.name), "declared": pick(lambda r: r.severity), "scope": pick(lambda r: r.scope)})


def match_lines(files: DataFrame, rules: Sequence[Rule], symbols: DataFrame | None = None, honor_flags: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Line mode. files: path, content, language. symbols: path, kind, name, start_line, end_line.

    A match in nested symbols is reported for each of them. column is the byte offset in the line, from 1. carry: columns
    of files that every match keeps. Rules whose scope is a symbol need symbols: without them ValueError.
    """
    rules = executable(list(rules))
    if symbols is None and (scoped := [r.id for r in rules if r.scope in SYMBOLS]):
        raise ValueError(f"symbols are needed for rules like {scoped[0]}")
    numbered = list(enumerate(rules))
    rows = text.exploded(files.where(F.col("language").isin(sorted({r.language for r in rules}))), "path", "language", *carry)
    by_language = F.array().cast("array<struct<seq:int,m:array<string>>>")
    for lang in sorted({r.language for r in rules}):
        own = [(i, r) for i, r in numbered if r.language == lang]
        comments, others = [x for x in own if x[1].scope == "Comments"], [x for x in own if x[1].scope != "Comments"]
        hits = _hits(F.col("line"), others, False, honor_flags)
        if comments:
            hits = F.concat(hits, F.when(text.is_comment(F.col("line")), _hits(F.col("line"), comments, False, honor_flags)).otherwise(by_language))
        by_language = F.when(F.col("language") == lang, hits).otherwise(by_language)
    rows = rows.select("path", "line_no", "line", *carry, F.explode(by_language).alias("hit"))
    rows = _named(_located(rows, "line", rules, False, honor_flags, "path", "line_no", *carry).drop("lines"), rules)
    flat = rows.where(F.col("scope").isin("File", "Comments")).withColumn("context", F.when(F.col("scope") == "Comments", F.lit("Comment")).otherwise(F.concat(F.lit("Line "), F.col("line_no").cast("string"))))
    if symbols is not None and any(r.scope in SYMBOLS for r in rules):
        s = symbols.select(F.col("path").alias("s_path"), "kind", F.col("name").alias("s_name"), "start_line", "end_line")
        inside = (F.col("path") == F.col("s_path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))
        function, kind = F.col("kind").isin("function", "method"), F.col("scope")
        fits = ((kind == "FunctionBody") & function) | ((kind == "ClassBody") & F.col("kind").isin("class", "struct")) | ((kind == "MethodSignature") & function & (F.col("line_no") == F.col("start_line")))
        label = F.when(kind == "FunctionBody", "Function: ").when(kind == "ClassBody", "Class: ").otherwise("Method signature: ")
        scoped = rows.where(F.col("scope").isin(*SYMBOLS)).join(s, inside & fits).withColumn("context", F.concat(label, F.col("s_name")))
        flat = flat.unionByName(scoped.select(*flat.columns))
    return flat.drop("scope")


def match_whole(files: DataFrame, rules: Sequence[Rule], honor_flags: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Whole-file mode: scopes are ignored, columns count characters."""
    rules = executable(list(rules))
    hits = F.array().cast("array<struct<seq:int,m:array<string>>>")
    for lang in sorted({r.language for r in rules}):
        hits = F.when(F.col("language") == lang, _hits(F.col("content"), [(i, r) for i, r in enumerate(rules) if r.language == lang], True, honor_flags)).otherwise(hits)
    rows = files.select("path", "content", *carry, F.explode(hits).alias("hit"))
    rows = _named(_located(rows, "content", rules, True, honor_flags, "path", *carry), rules)
    return rows.withColumns({"line_no": F.col("lines") + 1, "context": F.lit("Pattern match")}).drop("lines", "scope")


def detect(files: DataFrame, rules: Sequence[Rule], *, symbols: DataFrame | None = None, mode: str = "line", severity_context: str = "content", honor_flags: bool = False) -> DataFrame:
    """Detections with adjusted severities. severity_context: content (what a run sees), path+content or none."""
    if severity_context != "none":  # a file is classified where it is read, and its matches carry the result
        nothing = F.struct(F.lit(0.0).alias("confidence"), F.lit("NotTest").alias("test_type"))
        of_path = classify.path_part(F.col("path")) if "path" in severity_context else nothing
        files = files.withColumn("_test", classify._once(classify.content_part(F.col("content"), F.col("path")), lambda c: classify.combined(of_path, c)))
    carry = ["_test"] if severity_context != "none" else []
    rows = match_whole(files, rules, honor_flags, carry) if mode == "file" else match_lines(files, rules, symbols, honor_flags, carry)
    if not carry:
        return rows.withColumn("severity", F.col("declared")).select(*DETECTIONS)
    rows = rows.where(~classify.suppressed(F.col("rule_id"), F.col("_test.is_test")))
    return rows.withColumn("severity", classify.adjusted(F.col("declared"), F.col("_test.is_test"), F.col("_test.test_type"))).select(*DETECTIONS)
