"""Test-file classification and what it does to severities, as columns.

Confidences are doubles that are added in a fixed order: the limits (> 0.3 for
is_test, >= for the filter) can be met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscan.functions import text

# Ladders (the first that holds counts), keywords, markers, and their confidences.
DIRECTORIES = [
    (("/tests/", "\\tests\\"), ("/tests", "\\tests"), 0.4, "UnitTest"),
    (("/test/", "\\test\\"), ("/test", "\\test"), 0.4, "UnitTest"),
    (("spec",), (), 0.3, "UnitTest"),
    (("__tests__",), (), 0.4, "UnitTest"),
    (("integration",), (), 0.3, "IntegrationTest"),
    (("e2e", "end-to-end"), (), 0.3, "E2ETest"),
    (("benchmark", "benches"), (), 0.3, "BenchmarkTest"),
    (("mock", "fixture"), (), 0.3, "MockFile"),
    (("example", "demo"), (), 0.2, "ExampleCode"),
]
NAMES = [
    (r"^test[_-]", 0.3, "UnitTest"),
    (r"[_-]test\.(rs|py|js|ts)$", 0.3, "UnitTest"),
    (r"\.test\.(js|ts|py|go)$", 0.3, "UnitTest"),
    (r"\.spec\.(js|ts|py)$", 0.3, "UnitTest"),
    (r"[_-]test[_-]", 0.2, "UnitTest"),
    (r"mock", 0.2, "MockFile"),
    (r"fixture", 0.2, "MockFile"),
    (r"example|demo", 0.1, "ExampleCode"),
]
KEYWORDS = ("test", "spec", "__tests__", "integration", "e2e", "benchmark", "mock", "fixture", "example")
#: Per language: (any of these in the lower-cased content, confidence, type that it sets or None).
MARKERS = {
    "rust": [(("#[test]",), 0.5, "UnitTest"), (("#[cfg(test)]",), 0.4, "UnitTest"), (("#[bench]",), 0.4, "BenchmarkTest"), (("assert_eq!", "assert!", "assert_ne!"), 0.3, None), (("mod tests",), 0.4, "UnitTest")],
    "python": [(("import unittest", "from unittest"), 0.4, "UnitTest"), (("import pytest", "from pytest"), 0.4, "UnitTest"), (("import doctest",), 0.3, "DocumentationTest")],
    "go": [(('import "testing"',), 0.4, "UnitTest")],
}
FRAMEWORKS = ("jest", "mocha", "jasmine", "vitest", "ava", "tape", "qunit")
CALLS = ("describe(", "it(", "test(", "expect(", "beforeeach(", "aftereach(")
GENERIC = ("test", "assert", "mock", "fixture", "setup", "teardown", "before", "after", "expect", "should", "verify")
SUPPRESSED = ("todo_pattern", "unimplemented_pattern", "debug_print", "hardcoded_values", "magic_numbers", "unused_variables", "code_duplication")
LIMIT = 0.3


def _has(x: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def _points(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def path_part(path: Column) -> Column:
    """struct<confidence, test_type> of a path."""
    up, name, whole = F.lower(text.parent(path)), F.lower(text.file_name(path)), F.lower(path)
    directory, kind = F.lit(0.0), F.lit(None).cast("string")
    for inside, ends, value, what in reversed(DIRECTORIES):
        hit = _has(up, inside)
        for e in ends:
            hit = hit | up.endswith(e)
        directory, kind = F.when(hit, F.lit(value)).otherwise(directory), F.when(hit, F.lit(what)).otherwise(kind)
    named, name_kind = F.lit(0.0), F.lit(None).cast("string")
    for pattern, value, what in reversed(NAMES):
        named, name_kind = F.when(name.rlike(pattern), F.lit(value)).otherwise(named), F.when(name.rlike(pattern), F.lit(what)).otherwise(name_kind)
    total = directory + named
    for word in KEYWORDS:
        total = total + _points(whole.contains(word), 0.1)
    return F.struct(total.alias("confidence"), F.coalesce(kind, name_kind, F.lit("NotTest")).alias("test_type"))


def _added(start: Column, n: Column, value: float) -> Column:
    """start, with value added n times, one after the other."""
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: s + F.lit(value))


def _marked(low: Column, language: str) -> tuple[Column, Column]:
    value, kind = F.lit(0.0), F.lit("NotTest")
    for parts, points, what in MARKERS[language]:
        hit = _has(low, parts)
        value = value + _points(hit, points)
        if what:
            kind = F.when(hit, F.lit(what)).otherwise(kind)
    return value, kind


def _lines_with(low: Column, what: str) -> Column:
    """The lines that hold something; the expression runs only over texts that do."""
    found = F.regexp_extract_all(low, F.lit(rf"(?dm)^.*(?:{what}).*"), F.lit(0))
    return F.when(low.rlike(what), found).otherwise(F.array().cast("array<string>"))


def _rust(low: Column) -> Column:
    value, kind = _marked(low, "rust")
    uses = F.when(low.contains("use"), F.regexp_count(low, F.lit("(?dm)^use.*(?:test|mock).*"))).otherwise(F.lit(0))
    return _part(F.when(uses > 0, _added(value, F.greatest(uses, F.lit(1)), 0.2)).otherwise(value), kind)


def _python(low: Column) -> Column:
    value, kind = _marked(low, "python")
    test, claim = r"(?U)^\s*def test_", r"(?U)assert .*\S"  # on a line without the white space around it
    rows = _lines_with(low, "def test_|assert ")
    suite = _has(low, ("class test", "(unittest.testcase)"))

    def of_rows(x: Column) -> Column:
        # a line adds 0.3, then 0.2, in the order of lines
        total = F.aggregate(x, value, lambda s, line: s + _points(line.rlike(test), 0.3) + _points(line.rlike(claim), 0.2))
        named = F.when((kind == "NotTest") & F.exists(x, lambda line: line.rlike(test)), F.lit("UnitTest")).otherwise(kind)
        return _part(total + _points(suite, 0.3), F.when(suite, F.lit("UnitTest")).otherwise(named))

    return _once(rows, of_rows)


def _script(low: Column) -> Column:
    value, kind = F.lit(0.0), F.lit("NotTest")
    for f in FRAMEWORKS:
        hit = _has(low, (f"import {f}", f"require('{f}')", f'require("{f}")'))
        value, kind = value + _points(hit, 0.4), F.when(hit, F.lit("UnitTest")).otherwise(kind)
    for f in CALLS:
        value, kind = value + _points(low.contains(f), 0.3), F.when(low.contains(f), F.lit("UnitTest")).otherwise(kind)
    return _part(value, kind)


def _go(low: Column) -> Column:
    value, kind = _marked(low, "go")
    tests = lambda x: x.rlike(r"(?U)^\s*func test") & x.contains("*testing.t")
    benches = lambda x: x.rlike(r"(?U)^\s*func benchmark") & x.contains("*testing.b")

    def of_rows(x: Column) -> Column:
        total = F.aggregate(x, value, lambda s, line: s + _points(tests(line), 0.4) + _points(benches(line), 0.4))
        last = F.get(F.filter(x, lambda line: tests(line) | benches(line)), F.size(F.filter(x, lambda line: tests(line) | benches(line))) - 1)
        return _part(total, F.when(last.isNull(), kind).when(benches(last), F.lit("BenchmarkTest")).otherwise(F.lit("UnitTest")))

    return _once(_lines_with(low, "func test|func benchmark"), of_rows)


def _other(low: Column) -> Column:
    found = sum((F.when(low.contains(w), 1).otherwise(0) for w in GENERIC), F.lit(0))
    return F.when(found >= 3, _part(F.lit(0.2), F.lit("Unknown"))).otherwise(_part(F.lit(0.0), F.lit("NotTest")))


def _part(confidence: Column, kind: Column) -> Column:
    return F.struct(confidence.alias("confidence"), kind.alias("test_type"))


def _once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def content_part(content: Column, path: Column) -> Column:
    """struct<confidence, test_type> of a content; test_type is NotTest where nothing sets one. A later marker's type takes the place of an earlier one's.

    The content is brought to lower case once, and only its language's ladder is climbed.
    """
    lang = text.classified_language(path)
    ladders = ((("rust",), _rust), (("python",), _python), (("javascript", "typescript"), _script), (("go",), _go))

    def climb(low: Column) -> Column:
        out = _other(low)
        for names, ladder in reversed(ladders):
            out = F.when(lang.isin(*names), ladder(low)).otherwise(out)
        return out

    return _once(F.lower(content), climb)


def indicators(content: Column, path: Column) -> Column:
    """array<string>: what speaks for a test: directory, name, keyword and content markers that are found, in this order."""
    up, name, whole, low = F.lower(text.parent(path)), F.lower(text.file_name(path)), F.lower(path), F.lower(content)
    found = [F.when(_has(up, inside), F.lit(f"directory: {inside[0]}")) for inside, *_ in DIRECTORIES]
    found += [F.when(name.rlike(p), F.lit(f"name: {p}")) for p, *_ in NAMES]
    found += [F.when(whole.contains(w), F.lit(f"keyword: {w}")) for w in KEYWORDS]
    lang = text.classified_language(path)
    found += [F.when((lang == language) & _has(low, parts), F.lit(f"content: {parts[0]}")) for language, rows in MARKERS.items() for parts, *_ in rows]
    return F.array_compact(F.array(*found))


def combined(of_path: Column, of_content: Column) -> Column:
    """struct<is_test, confidence, test_type>; the content's type goes before the path's."""
    confidence = F.least(of_path["confidence"] + of_content["confidence"], F.lit(1.0))
    kind = F.when(of_content["test_type"] != "NotTest", of_content["test_type"]).otherwise(of_path["test_type"])
    return F.struct((confidence > LIMIT).alias("is_test"), confidence.alias("confidence"), kind.alias("test_type"))


def classified(content: Column, path: Column) -> Column:
    """struct<is_test, confidence, test_type, indicators, should_suppress> of a file."""
    return _once(combined(path_part(path), content_part(content, path)), lambda t: F.struct(t["is_test"].alias("is_test"), t["confidence"].alias("confidence"), t["test_type"].alias("test_type"), indicators(content, path).alias("indicators"), t["is_test"].alias("should_suppress")))


def suppressed(rule_id: Column, is_test: Column) -> Column:
    return is_test & _has(rule_id, SUPPRESSED)


def adjusted(severity: Column, is_test: Column, test_type: Column) -> Column:
    soft = test_type.isin("MockFile", "ExampleCode")
    down = (
        F.when(severity == "Critical", F.lit("High"))
        .when(severity == "High", F.when(soft, F.lit("Low")).otherwise(F.lit("Medium")))
        .when(severity == "Medium", F.when(soft, F.lit("Info")).otherwise(F.lit("Low")))
        .otherwise(F.lit("Info"))
    )
    return F.when(is_test, down).otherwise(severity)
