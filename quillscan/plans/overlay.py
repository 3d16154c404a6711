"""Source files made from the documents table: a path, a content that ends in a snippet of code, and the snippet's symbol.

The expressions are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import text

_DIRS = ("src", "a/tests", "a/test", "spec", "integration", "e2e", "benches", "mocks", "demo")
_STEMS = ("main", "test_unit", ".hidden", "a_test", "util", "fixture", "lib")
_EXTS = (".rs", ".py", ".ts", ".js", ".go", ".cpp", ".txt", "")
SNIPPETS = {
    0: ("fn a() {|    // TODO: finish|    unimplemented!()|}", "fn b() {|    let x = q.unwrap().unwrap(); // é|    é.unwrap(); dbg!(x)|}", "#[test]|fn c() {|    assert!(true);|    q.unwrap(); return 42; // mock|}", "fn d() {|    return 42; // mock number|    Err(_) => {} // FIXME: x|}",
        "fn check(u) {|    // same as above|    // quick fix|    if validate(u) { return true; }|    panic!(\"TODO: later\");|    Ok(()) // placeholder|}", "fn e() {|    let n = 42; // magic|    sleep(5); // simulate|    return Err(\"failed\");|    x.expect(\"TODO: why\");|    Config::default(); // lazy|}"),
    1: ("def a(x=[]):|    # FIXME: later|    raise NotImplementedError", "def b():|    try: go()|    except: pass|    return None", "import pytest|def test_c():|    assert False|    # hack for now", "class T:|    def d(self):|        eval(x)|        return [1]",
        "def check():|    # same as above|    if verify(u): return True|    n = 42  # placeholder|    time.sleep(5)  # simulate|    raise (\"failed\")|def p(): pass", "class Z:|    def q(self):|        return 1"),
    2: ("function a(x: any) {|    // @ts-ignore|    return x as any;|}", "function b() {|    console.log(\"debug\");|    return null|}", "describe(() => {|    it(() => { return 1; });|});", "function d() {|    // TODO: x|    throw new Error(\"not implemented\")|}",
        "function check(u) {|    // same as above|    // quick fix|    if (validate(u)) return true;|    setTimeout(go, 10); // simulate|    try { go(); } catch (e) { }|    return [1]; // mock|}", "function z() { }|throw (\"failed\");|return Promise.resolve(null); // placeholder"),
    3: ("function e() { }", "function f(a, b) { return a }", "expect(1)|function g() {}", "const jest = 1", "import jest", "let x = 1"),
    4: ("import \"testing\"|func TestA(t *testing.T) {|}", "func BenchmarkB(b *testing.B) {|}", "func c() {|}", "package d", "func TestB(t *testing.T) {|}|func BenchmarkC(b *testing.B) {|}", "package e"),
    5: ("int setup() { assert(mock()); }", "int b() { return ((1)); }", "// verify before expect|int c() {}", "struct D { int x[3]; };", "int e;", "int f;"),
    6: ("plain",) * 6,
    7: ("plain",) * 6,
}


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _code(snippet: str) -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in snippet.split("|"))


PATH = f"source || '/' || {_case('doc_id % 9', _DIRS)} || '/' || {_case('doc_id % 7', _STEMS)} || CAST(doc_id AS STRING) || {_case('doc_id % 8', _EXTS)}"
_PICK = "CAST(floor(doc_id / 8) AS BIGINT) % 6"
SNIPPET = "CASE doc_id % 8 " + " ".join(f"WHEN {e} THEN CASE {_PICK} " + " ".join(f"WHEN {i} THEN {_code(s)}" for i, s in enumerate(picks)) + " END" for e, picks in SNIPPETS.items()) + " END"
CONTENT = f"coalesce(text, '') || chr(10) || {SNIPPET}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"))
    return rows.withColumns({"size_bytes": F.octet_length("content").cast("long"), "language": text.language(F.col("path"))})


def symbols(data: DataFrame) -> DataFrame:
    """A function over each snippet, a class where doc_id is even, and an inner function on its last line."""
    size, n = F.size(text.lines(F.col("content"))), F.size(F.split(F.expr("CASE doc_id % 8 " + " ".join(f"WHEN {e} THEN CASE {_PICK} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(p)) + " END" for e, p in SNIPPETS.items()) + " END"), r"\|"))
    base = data.select("doc_id", "path", (size - n + 1).alias("s"), size.alias("e"))
    kinds = F.array(F.struct(F.lit("function").alias("kind"), F.lit("outer").alias("name"), F.col("s").alias("a")), F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit("class")).otherwise(F.lit("method")).alias("kind"), F.lit("Held").alias("name"), F.col("s").alias("a")), F.struct(F.lit("function").alias("kind"), F.lit("inner").alias("name"), F.col("e").alias("a")))
    return base.select("path", "e", F.explode(kinds).alias("k")).select("path", "k.kind", "k.name", F.col("k.a").alias("start_line"), F.col("e").alias("end_line"))


#: DuckDB: f (doc_id, path, content, name, up, ext, language, size_bytes), l (path, language, line_no, line), s (symbols).
BY = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in text.BY_EXTENSION.items())
CTE = f"""WITH f0 AS (SELECT doc_id, {PATH} AS path, {CONTENT} AS content, len(string_split({SNIPPET}, chr(10))) AS n FROM documents),
f1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS up FROM f0),
f2 AS (SELECT *, CASE WHEN regexp_matches(name, '^.+[.][^.]*$') THEN regexp_extract(name, '^.+[.]([^.]*)$', 1) END AS ext FROM f1),
f3 AS (SELECT *, string_split_regex(content, '\\r?\\n') AS ls0 FROM f2),
f AS (SELECT *, CASE WHEN ls0[-1] = '' THEN ls0[:-2] ELSE ls0 END AS ls, CASE lower(ext) {BY} END AS language, octet_length(encode(content)) AS size_bytes FROM f3),
l AS (SELECT path, language, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM f),
s AS (SELECT path, 'function' AS kind, 'outer' AS sname, len(ls) - n + 1 AS a, len(ls) AS b FROM f
 UNION ALL SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'method' END, 'Held', len(ls) - n + 1, len(ls) FROM f
 UNION ALL SELECT path, 'function', 'inner', len(ls), len(ls) FROM f)"""
