"""The registered queries, one or more for each operator, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import classify, text
from quillscan.operators import control, match, report, score
from quillscan.operators import rules as R
from quillscan.plans import overlay
from quillscan.plans.overlay import CTE
from quillscan.streaming import watch

ALL = R.packs()
SHIPPED = R.packs(["shipped"])
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return keep


files = overlay.files


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- sources, projections, filters -------------------------------------------


@query(CTE + " SELECT path, size_bytes::BIGINT AS size_bytes, length(content)::BIGINT AS chars FROM f")
def src_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", "size_bytes", F.length("content").cast("long").alias("chars"))


@query(CTE + " SELECT path, line_no, md5(line) AS line_md5 FROM l")
def lines_split(spark, sf):
    return text.exploded(files(spark, sf), "path").select("path", "line_no", F.md5("line").alias("line_md5"))


@query(CTE + " SELECT path, ext, up, name, language FROM f")
def path_parts(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("path", text.extension(p).alias("ext"), text.parent(p).alias("up"), text.file_name(p).alias("name"), "language")


_CLS_LANG = "CASE lower(ext) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in text.CLASSIFIED.items()) + " ELSE 'rust' END"


@query(CTE + f" SELECT path, {_CLS_LANG} AS lang FROM f")
def lang_classifier(spark, sf):
    return files(spark, sf).select("path", text.classified_language(F.col("path")).alias("lang"))


def _filtered(oracle_where: str, name: str, **kwargs):
    query(CTE + f" SELECT path FROM f WHERE {oracle_where}", name)(lambda spark, sf: text.wanted(files(spark, sf), **kwargs).select("path"))


_filtered("size_bytes <= 2000", "flt_size", max_bytes=2000)
_filtered("lower(ext) IN ('rs', 'py')", "flt_ext", max_bytes=None, extensions=["rs", " PY"])
_filtered("NOT contains(path, 'mocks') AND NOT contains(path, 'util')", "flt_exclude", max_bytes=None, exclude=["mocks", "util"])
_filtered("NOT regexp_matches(path, '(^|/)[.][^/]+')", "flt_hidden", max_bytes=None, include_hidden=False)


@query(CTE + " SELECT DISTINCT path FROM f WHERE lower(ext) IN (" + ", ".join(_q(c) for c in text.CODE) + ")")
def flt_code_files(spark, sf):
    return files(spark, sf).where(text.extension(F.col("path")).isin(*text.CODE)).select("path").distinct()


# --- classification ------------------------------------------------------------


def _any(x: str, parts, ends=()) -> str:
    return "(" + " OR ".join([f"contains({x}, {_q(p)})" for p in parts] + [f"ends_with({x}, {_q(e)})" for e in ends]) + ")"


_D = "CASE " + " ".join(f"WHEN {_any('lower(up)', a, b)} THEN {v}::DOUBLE" for a, b, v, _ in classify.DIRECTORIES) + " ELSE 0.0::DOUBLE END"
_DK = "CASE " + " ".join(f"WHEN {_any('lower(up)', a, b)} THEN '{k}'" for a, b, _, k in classify.DIRECTORIES) + " END"
_N = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {_q(p)}) THEN {v}::DOUBLE" for p, v, _ in classify.NAMES) + " ELSE 0.0::DOUBLE END"
_NK = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {_q(p)}) THEN '{k}'" for p, _, k in classify.NAMES) + " END"
_PATH_CONF = f"({_D} + {_N}" + "".join(f" + CASE WHEN contains(lower(path), '{w}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" for w in classify.KEYWORDS) + ")"
_PATH_KIND = f"coalesce({_DK}, {_NK}, 'NotTest')"


def _add(cond: str, v: float) -> str:
    return f"CASE WHEN {cond} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"


def _fold(start: str, *cases: tuple[str, float]) -> str:
    steps = " + ".join(["a", *[_add(c, v) for c, v in cases]])
    return f"list_reduce(list_prepend({start}, list_transform(ls, lambda x: 0.0::DOUBLE)), lambda a, y, i: {steps.replace('@', 'lower(ls[i])')})"


_LOW = "lower(content)"
_M = {k: " + ".join(["0.0::DOUBLE", *[_add(_any(_LOW, p), v) for p, v, _ in rows]]) for k, rows in classify.MARKERS.items()}
_CONTENT_CONF = f"""CASE {_CLS_LANG} WHEN 'rust' THEN {_fold(_M['rust'], ("starts_with(@, 'use') AND (contains(@, 'test') OR contains(@, 'mock'))", 0.2))}
WHEN 'python' THEN {_fold(_M['python'], ("starts_with(trim(@), 'def test_')", 0.3), ("contains(trim(@), 'assert ')", 0.2))} + {_add(_any(_LOW, ("class test", "(unittest.testcase)")), 0.3)}
WHEN 'go' THEN {_fold(_M['go'], ("starts_with(trim(@), 'func test') AND contains(@, '*testing.t')", 0.4), ("starts_with(trim(@), 'func benchmark') AND contains(@, '*testing.b')", 0.4))}
WHEN 'c' THEN 0.0::DOUBLE WHEN 'cpp' THEN CASE WHEN {' + '.join(f"contains({_LOW}, '{w}')::INT" for w in classify.GENERIC)} >= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
ELSE {' + '.join(['0.0::DOUBLE', *[_add(_any(_LOW, (f"import {x}", f"require('{x}')", f'require("{x}")')), 0.4) for x in classify.FRAMEWORKS], *[_add(f"contains({_LOW}, '{c}')", 0.3) for c in classify.CALLS]])} END"""


@query(CTE + f" SELECT path, round({_PATH_CONF}, 6) AS confidence, {_PATH_KIND} AS test_type FROM f")
def cls_path(spark, sf):
    part = classify.path_part(F.col("path"))
    return files(spark, sf).select("path", F.round(part["confidence"], 6).alias("confidence"), part["test_type"].alias("test_type"))


@query(CTE + f" SELECT path, round({_CONTENT_CONF}, 6) AS confidence FROM f")
def cls_content(spark, sf):
    return files(spark, sf).select("path", F.round(classify.content_part(F.col("content"), F.col("path"))["confidence"], 6).alias("confidence"))


@query(CTE + f" SELECT path, round(least({_PATH_CONF} + {_CONTENT_CONF}, 1.0), 6) AS confidence, least({_PATH_CONF} + {_CONTENT_CONF}, 1.0) > 0.3::DOUBLE AS is_test FROM f")
def cls_combined(spark, sf):
    got = classify.combined(classify.path_part(F.col("path")), classify.content_part(F.col("content"), F.col("path")))
    rows = files(spark, sf).select("path", got.alias("t"))
    return rows.select("path", F.round("t.confidence", 6).alias("confidence"), "t.is_test")


@query(CTE + f" SELECT path FROM f WHERE least({_PATH_CONF} + {_CONTENT_CONF}, 1.0) < 0.3::DOUBLE")
def flt_tests(spark, sf):
    got = classify.combined(classify.path_part(F.col("path")), classify.content_part(F.col("content"), F.col("path")))
    return files(spark, sf).where(got["confidence"] < 0.3).select("path")


_SEV = "(VALUES ('Info'), ('Low'), ('Medium'), ('High'), ('Critical')) s(severity), (VALUES ('UnitTest'), ('MockFile'), ('ExampleCode'), ('NotTest')) k(test_type)"


@query(f"""SELECT severity, test_type, CASE WHEN test_type = 'NotTest' THEN severity WHEN severity = 'Critical' THEN 'High'
WHEN severity = 'High' THEN CASE WHEN test_type = 'UnitTest' THEN 'Medium' ELSE 'Low' END
WHEN severity = 'Medium' THEN CASE WHEN test_type = 'UnitTest' THEN 'Low' ELSE 'Info' END ELSE 'Info' END AS adjusted FROM {_SEV}""")
def sev_adjust(spark, sf):
    rows = [(s, k) for s in R.SEVERITIES for k in ("UnitTest", "MockFile", "ExampleCode", "NotTest")]
    df = spark.createDataFrame(rows, "severity string, test_type string")
    return df.withColumn("adjusted", classify.adjusted(F.col("severity"), F.col("test_type") != "NotTest", F.col("test_type")))


# --- matching -------------------------------------------------------------------


def _det(rules, whole: bool = False) -> str:
    """One branch for each rule: path, seq, rule_id, declared, line_no, snippet, scope."""
    out = []
    for i, r in enumerate(rules):
        only = f"language = '{r.language}'"
        if r.scope == "Comments" and not whole:
            only += """ AND regexp_matches(trim(line), '^(//|#|/[*]|[*]|""\"|'''''')')"""
        src, line = ("f", "0") if whole else ("l", "line_no")
        out.append(f"SELECT path, {i} AS seq, '{r.id}' AS rule_id, '{r.severity}' AS declared, {line} AS line_no, unnest(regexp_extract_all({'content' if whole else 'line'}, {_q(r.pattern)})) AS snippet, '{r.scope}' AS scope FROM {src} WHERE {only}")
    return " UNION ALL ".join(out)


_SCOPED = """m0 AS (SELECT path, seq, rule_id, declared, line_no, snippet, 'Comment' AS context FROM d WHERE scope = 'Comments'
UNION ALL SELECT path, seq, rule_id, declared, line_no, snippet, 'Line ' || line_no FROM d WHERE scope = 'File'
UNION ALL SELECT d.path, seq, rule_id, declared, line_no, snippet, 'Function: ' || sname FROM d JOIN s ON d.path = s.path AND line_no BETWEEN a AND b AND kind IN ('function', 'method') WHERE scope = 'FunctionBody'
UNION ALL SELECT d.path, seq, rule_id, declared, line_no, snippet, 'Class: ' || sname FROM d JOIN s ON d.path = s.path AND line_no BETWEEN a AND b AND kind IN ('class', 'struct') WHERE scope = 'ClassBody'
UNION ALL SELECT d.path, seq, rule_id, declared, line_no, snippet, 'Method signature: ' || sname FROM d JOIN s ON d.path = s.path AND line_no = a AND kind IN ('function', 'method') WHERE scope = 'MethodSignature')"""


def _matches(rules) -> str:
    return f"{CTE}, d AS ({_det(rules)}), {_SCOPED} "


def _rescoped(scope: str) -> list[R.Rule]:
    from dataclasses import replace

    return [replace(r, scope=scope) for r in SHIPPED if r.scope == "FunctionBody"]


def _match(name: str, rules):
    def run(spark, sf):
        data = files(spark, sf)
        return match.match_lines(data, rules, overlay.symbols(data)).select("path", "rule_id", F.col("line_no").cast("int").alias("line_no"), "snippet", "context")

    query(_matches(rules) + "SELECT path, rule_id, line_no, snippet, context FROM m0", name)(run)


_match("match_file", _rescoped("File"))
_match("match_comments", [r for r in SHIPPED if r.scope == "Comments"])
_match("match_function", [r for r in SHIPPED if r.scope == "FunctionBody"])
_match("match_class", _rescoped("ClassBody"))
_match("match_signature", _rescoped("MethodSignature"))
_match("match_all_packs", ALL)
_COLUMNS = [r for r in _rescoped("File") if r.id == "rust_unwrap_without_context"]


@query(CTE + """, p AS (SELECT path, line_no, string_split(line, '.unwrap()') AS ps FROM l WHERE language = 'rust'),
q AS (SELECT path, line_no, ps, unnest(range(1, len(ps))) AS i FROM p)
SELECT path, line_no, octet_length(encode(array_to_string(ps[1:i], '.unwrap()')))::INT + 1 AS "column" FROM q""")
def match_columns(spark, sf):
    return match.match_lines(files(spark, sf), _COLUMNS).select("path", F.col("line_no").cast("int").alias("line_no"), F.col("column").cast("int").alias("column"))


_WHOLE = [r for r in SHIPPED if "$" not in r.pattern]


@query(f"{CTE}, d AS ({_det(_WHOLE, True)}) SELECT path, rule_id, snippet FROM d")
def match_wholefile(spark, sf):
    return match.match_whole(files(spark, sf), _WHOLE).select("path", "rule_id", "snippet")


_WHOLE_ENDS = [r for r in SHIPPED if "$" in r.pattern]


@query(f"{CTE}, d AS ({_det(_WHOLE_ENDS, True)}) SELECT path, rule_id, snippet FROM d")
def match_wholefile_ends(spark, sf):
    """The shipped rules that match_wholefile leaves out."""
    return match.match_whole(files(spark, sf), _WHOLE_ENDS).select("path", "rule_id", "snippet")


_TEST = f"({_CONTENT_CONF}) > 0.3::DOUBLE"
_ADJ = "CASE WHEN NOT is_test THEN declared WHEN declared = 'Critical' THEN 'High' WHEN declared = 'High' THEN 'Medium' WHEN declared = 'Medium' THEN 'Low' ELSE 'Info' END"
_SUPP = " OR ".join(f"contains(rule_id, '{x}')" for x in classify.SUPPRESSED)
_DETECTED = f"{CTE}, d AS ({_det(ALL)}), {_SCOPED}, t AS (SELECT path AS tp, language, doc_id, {_TEST} AS is_test FROM f), det AS (SELECT m0.*, {_ADJ} AS severity FROM m0 JOIN t ON path = tp WHERE NOT (is_test AND ({_SUPP}))) "


def _detected(spark, sf):
    data = files(spark, sf)
    return data, match.detect(data, ALL, symbols=overlay.symbols(data))


@query(_DETECTED + "SELECT path, seq, rule_id, severity, line_no, snippet, context FROM det")
def detections(spark, sf):
    return _detected(spark, sf)[1].select("path", "seq", "rule_id", "severity", F.col("line_no").cast("int").alias("line_no"), "snippet", "context")


# --- scores ---------------------------------------------------------------------

_RES = _DETECTED + f""", r AS (SELECT tp AS path, t.language, count(rule_id)::BIGINT AS issues, count(*) FILTER (severity = 'Critical')::BIGINT AS criticals,
greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(CASE severity {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.PENALTY.items())} END), 0)) AS score FROM t LEFT JOIN det ON path = tp GROUP BY ALL) """


@query(_RES + "SELECT path, language, issues, criticals, score FROM r")
def score_file(spark, sf):
    return score.file_results(*_detected(spark, sf))


@query(_RES + "SELECT count(*)::BIGINT AS total_files, sum(issues)::BIGINT AS total_detections, sum(criticals)::BIGINT AS critical_issues, round(avg(score), 6) AS average_quality_score FROM r")
def score_summary(spark, sf):
    return score.summary(score_file(spark, sf)).withColumn("average_quality_score", F.round("average_quality_score", 6))


@query(_RES + "SELECT round(avg(score), 6) AS score, sum(criticals)::BIGINT AS criticals, avg(score) >= 80 AND sum(criticals) <= 0 AS passed FROM r")
def gate(spark, sf):
    row = control.gate(score.summary(score_file(spark, sf)))
    return row.select(F.round("average_quality_score", 6).alias("score"), F.col("critical_issues").alias("criticals"), "passed")


def _loss(*cases: tuple[str, float]) -> str:
    return "greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE " + " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v in cases) + " ELSE 0.0::DOUBLE END))"


_un, _pa, _uw, _se, _to = (f"contains(rule_id, '{x}')" for x in ("unimplemented", "panic", "unwrap", "security", "todo"))
_ASSESS = f""", a AS (SELECT path, {_loss((f"severity = 'Medium' AND NOT {_to}", 5.0), ("severity = 'Low'", 2.0), ("severity = 'Info'", 0.5))} AS maintainability,
{_loss((f"severity = 'Critical' AND NOT {_un} AND {_pa}", 20.0), (f"severity = 'Critical' AND NOT {_un}", 15.0), (f"severity = 'High' AND {_uw}", 10.0), (f"severity = 'High' AND NOT {_se}", 8.0))} AS reliability,
{_loss((f"severity = 'High' AND NOT {_uw} AND {_se}", 15.0))} AS security, {_loss((f"severity = 'Critical' AND {_un}", 25.0), (f"severity = 'Medium' AND {_to}", 5.0))} AS completeness FROM det GROUP BY path) """


@query(_DETECTED + _ASSESS + "SELECT path, maintainability, reliability, security, completeness, round(maintainability * 0.25 + reliability * 0.3 + 20 + security * 0.15 + completeness * 0.1, 6) AS overall FROM a")
def assess_simple(spark, sf):
    return score.assessment(_detected(spark, sf)[1]).select("path", "maintainability", "reliability", "security", "completeness", F.round("overall", 6).alias("overall"))


@query(_DETECTED + _ASSESS + """SELECT tp AS path, coalesce(maintainability, 100) AS maintainability, coalesce(reliability, 100) AS reliability, coalesce(security, 100) AS security, coalesce(completeness, 100) AS completeness,
round(coalesce(maintainability, 100) * 0.25 + coalesce(reliability, 100) * 0.3 + 20 + coalesce(security, 100) * 0.15 + coalesce(completeness, 100) * 0.1, 6) AS overall FROM t LEFT JOIN a ON a.path = tp""")
def assess_files(spark, sf):
    data, found = _detected(spark, sf)
    return score.assessment(found, data).select("path", "maintainability", "reliability", "security", "completeness", F.round("overall", 6).alias("overall"))


@query(_DETECTED + f"SELECT CASE WHEN {_un} THEN 'High' WHEN {_uw} THEN 'Medium' WHEN {_pa} THEN 'High' ELSE 'Low' END AS impact, count(*)::BIGINT AS n FROM det GROUP BY 1")
def impact_text(spark, sf):
    return _detected(spark, sf)[1].groupBy(score.impact(F.col("rule_id")).alias("impact")).agg(F.count("*").alias("n"))


@query(_DETECTED + "SELECT rule_id, severity, count(*)::BIGINT AS n FROM det GROUP BY ALL")
def severity_counts(spark, sf):
    return score.severity_counts(_detected(spark, sf)[1], "rule_id", "severity")


@query(CTE + """ SELECT path, len(ls)::BIGINT AS line_count, length(content)::BIGINT AS char_count, size_bytes::BIGINT AS file_size_bytes,
len(list_filter(ls, lambda x: contains(x, 'fn ') OR contains(trim(x), 'def ') OR contains(trim(x), 'function ') OR (contains(x, '(') AND contains(x, ')') AND contains(x, '{'))))::BIGINT AS function_count,
round(coalesce(len(list_filter(ls, lambda x: regexp_matches(trim(x), '^(//|#|/[*])'))) / nullif(len(list_filter(ls, lambda x: trim(x) <> '')), 0), 0), 6)::DOUBLE AS comment_ratio FROM f""")
def metrics_counts(spark, sf):
    return score.metrics(files(spark, sf)).select("path", "line_count", "char_count", "file_size_bytes", "function_count", F.round("comment_ratio", 6).alias("comment_ratio"))


@query(CTE + """, c AS (SELECT path, line_no, unnest(string_split(line, '')) AS ch, unnest(range(1, length(line) + 1)) AS pos FROM l WHERE line <> ''),
v AS (SELECT *, CASE WHEN ch IN ('{', '(', '[') THEN 1 WHEN ch IN ('}', ')', ']') THEN -1 ELSE 0 END AS step FROM c),
r AS (SELECT *, sum(step) OVER w AS total FROM v WINDOW w AS (PARTITION BY path ORDER BY line_no, pos)),
g AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY path ORDER BY line_no, pos)) AS depth FROM r),
e AS (SELECT path, line_no, arg_max(depth, pos) AS depth FROM g GROUP BY ALL)
SELECT f.path, coalesce(max(depth), 0)::BIGINT AS nesting_depth FROM f LEFT JOIN e USING (path) GROUP BY f.path""")
def metrics_nesting(spark, sf):
    return score.metrics(files(spark, sf)).select("path", "nesting_depth")


@query(_DETECTED + """, n AS (SELECT path, rule_id, line_no, row_number() OVER (PARTITION BY path ORDER BY seq, line_no) AS rn, greatest(count(*) OVER (PARTITION BY path) - 3, 0)::BIGINT AS more FROM det)
SELECT path, rule_id, line_no, rn::INT AS rn, more FROM n WHERE rn <= 3""")
def report_top3(spark, sf):
    rows = score.first_per_file(_detected(spark, sf)[1])
    return rows.select("path", "rule_id", F.col("line_no").cast("int").alias("line_no"), F.col("rn").cast("int").alias("rn"), F.col("more").cast("long").alias("more"))


@query(_DETECTED + "SELECT path, count(*) FILTER (severity = 'Critical')::BIGINT AS criticals, count(*) FILTER (severity = 'High')::BIGINT AS highs FROM det GROUP BY path")
def severe_counts(spark, sf):
    return score.severe_counts(_detected(spark, sf)[1])


@query(CTE + """ SELECT path, count(*) FILTER (kind IN ('function', 'method'))::BIGINT AS n_functions, count(*) FILTER (kind NOT IN ('function', 'method'))::BIGINT AS n_types,
array_to_string(list_sort(list_distinct(list(sname) FILTER (kind IN ('function', 'method')))), ',') AS functions FROM s GROUP BY path""")
def symbol_summary(spark, sf):
    return score.symbol_summary(overlay.symbols(files(spark, sf))).withColumn("functions", F.array_join("functions", ","))


@query(CTE + """ SELECT path, 2 + (doc_id % 2) AS n_functions, 1 - (doc_id % 2) AS n_types, len(list_filter(ls, lambda x: regexp_matches(lower(x), '(check|validate|verify|assert)')))::BIGINT AS n_validations FROM f""")
def semantic_summary(spark, sf):
    data = files(spark, sf)
    return score.semantic_summary(data, overlay.symbols(data)).select("path", "n_functions", "n_types", "n_validations")


@query("SELECT event_id, user_id, round(lag(value) OVER w, 6) AS before, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def run_trend(spark, sf):
    rows = score.run_trend(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_id", "value")
    return rows.select("event_id", "user_id", F.round("before", 6).alias("before"), F.round("change", 6).alias("change"))


@query(_DETECTED + "SELECT path, arg_max(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS severity FROM det GROUP BY path")
def most_severe(spark, sf):
    return score.most_severe(_detected(spark, sf)[1]).select("path", "severity")


@query(_RES + "SELECT path, printf('%s: %d issues, %.1f%% quality', path, issues, score) AS line FROM r WHERE issues > 0")
def report_compact(spark, sf):
    return report.compact(score_file(spark, sf))


@query(CTE + """ SELECT path, line_no, coalesce(array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS before,
coalesce(array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)), '') AS after FROM l""")
def context_window(spark, sf):
    return text.context(text.exploded(files(spark, sf), "path")).select("path", "line_no", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


# --- checkpoints, gates, tasks --------------------------------------------------


def _two(spark, sf):
    """Two states of all files: some renamed, some changed, some with null contents."""
    data, every = files(spark, sf), lambda n: F.col("doc_id") % n == 0
    old = data.withColumns({"path": F.when(every(5), F.concat("path", F.lit(".old"))).otherwise(F.col("path")), "content": F.when(every(13), None).when(every(7), F.concat("content", F.lit("x"))).otherwise(F.col("content"))})
    new = data.withColumns({"path": F.when(every(11), F.concat("path", F.lit(".new"))).otherwise(F.col("path")), "content": F.when(every(17), None).otherwise(F.col("content"))})
    return control.snapshot(old), control.snapshot(new)


@query(CTE + " SELECT path, size_bytes::BIGINT AS size, sha256(content) AS content_hash FROM f")
def ckpt_snapshot(spark, sf):
    return control.snapshot(files(spark, sf))


_DIFF = CTE + """, o AS (SELECT path || CASE WHEN doc_id % 5 = 0 THEN '.old' ELSE '' END AS path, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE content || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END END AS c FROM f),
w AS (SELECT path || CASE WHEN doc_id % 11 = 0 THEN '.new' ELSE '' END AS path, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE content END AS c FROM f),
x AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'deleted' WHEN o.c IS DISTINCT FROM w.c THEN 'changed' END AS change FROM o FULL JOIN w ON o.path = w.path) """


@query(_DIFF + "SELECT path, change FROM x WHERE change IS NOT NULL")
def ckpt_diff(spark, sf):
    return control.diff(*_two(spark, sf))


@query(_DIFF + "SELECT path, language FROM f WHERE path IN (SELECT path FROM x WHERE change IN ('new', 'changed'))")
def ckpt_incremental(spark, sf):
    return control.changed_files(files(spark, sf), control.diff(*_two(spark, sf))).select("path", "language")


@query(CTE + """, d AS (SELECT path || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.draft' END AS path FROM f), r AS (SELECT path || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.old' END AS path FROM f)
SELECT path FROM d WHERE path NOT IN (SELECT path FROM r)""")
def gate_hidden_files(spark, sf):
    named = lambda n, other: files(spark, sf).select(F.when(F.col("doc_id") % n == 0, F.col("path")).otherwise(F.concat("path", F.lit(other))).alias("path"))
    return control.hidden_files(named(3, ".draft"), named(2, ".old"))


@query(_RES + """, k AS (SELECT doc_id // 10 AS id, tp AS path FROM t), q AS (SELECT id, avg(score) AS quality, sum(criticals)::BIGINT AS criticals FROM k JOIN r USING (path) GROUP BY id)
SELECT id, round(quality, 6) AS quality, criticals, CASE WHEN quality >= 80 AND criticals <= 0 THEN 'completed' ELSE 'needs-revision' END AS status, quality >= 80 AND criticals <= 0 AS verified FROM q""")
def tasks_workflow(spark, sf):
    data, found = _detected(spark, sf)
    tasks = data.groupBy(F.floor(F.col("doc_id") / 10).alias("id")).agg(F.collect_list("path").alias("files")).withColumns({"quality_threshold": F.lit(80.0), "max_critical_issues": F.lit(0)})
    return control.task_states(tasks, score.file_results(data, found)).withColumn("quality", F.round("quality", 6))


# --- rules ----------------------------------------------------------------------


def _values(rules) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{r.id}', '{r.severity}', '{r.language}', '{r.playbook}')" for i, r in enumerate(rules)) + ") v(seq, id, severity, language, playbook)"


@query(f"SELECT seq, id, severity, language, playbook FROM {_values(ALL)}")
def rules_catalog(spark, sf):
    return R.as_table(spark, ALL).select("seq", "id", "severity", "language", "playbook")


@query(f"SELECT id, count(*)::BIGINT AS n FROM {_values(ALL)} GROUP BY id HAVING count(*) > 1")
def rules_duplicates(spark, sf):
    return R.duplicates(R.as_table(spark, ALL))


_LEARNED = "SELECT 'learned_' || CAST(doc_id AS STRING) AS id, 'rule ' || CAST(doc_id AS STRING) AS name, lang AS language, CASE doc_id % 5 WHEN 0 THEN 'Info' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity, CAST(0.75 AS DOUBLE) + CAST(doc_id % 4 AS DOUBLE) / 16 AS confidence, CAST(doc_id * 7 % 101 AS BIGINT) AS detection_count FROM "


def _learned(spark, sf):
    return spark.sql(_LEARNED + "{docs}", docs=spark.read.parquet(f"{sf}/documents.parquet"))


@query(f"""SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS grouped, language, severity, count(*)::BIGINT AS n,
round(avg(confidence), 6) AS mean_confidence, sum(detection_count)::BIGINT AS detections FROM ({_LEARNED} documents) GROUP BY GROUPING SETS ((language), (severity), ())""")
def learn_stats(spark, sf):
    return control.learned_stats(_learned(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"SELECT id, detection_count FROM ({_LEARNED} documents) ORDER BY detection_count DESC, name LIMIT 10")
def learn_topk(spark, sf):
    return control.top_learned(_learned(spark, sf)).select("id", "detection_count")


@query("SELECT time_bucket(INTERVAL 10 minutes, ts, TIMESTAMP '1970-01-01') AS window_start, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def trend(spark, sf):
    return watch.trend(spark.read.parquet(f"{sf}/events.parquet")).withColumn("mean", F.round("mean", 6))
