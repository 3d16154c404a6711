import json

import pytest
from pyspark.sql import functions as F

from quillscan import cli
from quillscan.errors import CheckpointError, ConfigurationError, InvalidRuleError, NotSupportedError, PlaybookError
from quillscan.functions import classify, text
from quillscan.operators import control, match, report, rules, score
from quillscan.sources import files as src
from quillscan.streaming import watch

RUST = "// notes\n\nfn open_door(id: u64) -> bool {\n    // TODO: ask the lock\n    let k = find(id).unwrap();\n    unimplemented!()\n}\n\nstruct Door {\n    id: u64,\n}\n"
PYTHON = "class Door:\n    def open(self, keys=[]):\n        # FIXME: ask\n        try:\n            go()\n        except:\n            pass\n        raise NotImplementedError\n"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".cache").mkdir()
    (tmp_path / "src/door.rs").write_text(RUST)
    (tmp_path / "src/door.py").write_text(PYTHON)
    (tmp_path / "src/notes.txt").write_text("TODO: no rule for this")
    (tmp_path / "src/.secret.py").write_text("x = 1\n")
    (tmp_path / ".cache/a.py").write_text("x = 1\n")
    (tmp_path / "src/raw.py").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_files_and_symbols(spark, tree):
    names = lambda df: sorted(r["path"].rpartition("/")[2] for r in df.select("path").collect())
    data = src.read(spark, [str(tree), "/no/such/path"])
    assert names(data) == ["door.py", "door.rs", "notes.txt"]
    assert names(src.read(spark, [str(tree)], include_hidden=True)) == [".secret.py", "a.py", "door.py", "door.rs", "notes.txt"]
    assert names(src.read(spark, [str(tree)], extensions=["RS"])) == ["door.rs"]
    assert names(src.read(spark, [str(tree)], exclude=["door"], max_bytes=1000)) == ["notes.txt"]
    found = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in src.symbols(data).collect()}
    assert found == {("open_door", "function", 3, 7), ("Door", "struct", 9, 11), ("Door", "class", 1, 8), ("open", "method", 2, 8)}


def test_shipped_rules_on_files(spark, tree):
    data = src.read(spark, [str(tree / "src")])
    found = match.detect(data, rules.packs(["shipped"]), symbols=src.symbols(data))
    got = {(r["rule_id"], r["line_no"], r["column"]) for r in found.collect()}
    assert got == {
        ("rust_todo_comment", 4, 5), ("rust_unwrap_without_context", 5, 21), ("rust_unimplemented_macro", 6, 5),
        ("python_mutable_default_args", 2, 5), ("python_todo_comment", 3, 9), ("python_bare_except", 6, 9), ("python_not_implemented_error", 8, 9),
    }
    results = {r["path"].rpartition("/")[2]: r for r in score.file_results(data, found).collect()}
    assert results["door.rs"]["score"] == 100 - 8 - 8 - 25 and results["door.py"]["score"] == 100 - 15 - 8 - 15 - 25
    assert results["notes.txt"]["score"] == 100 and results["notes.txt"]["language"] is None
    both = match.detect(data, rules.packs(), symbols=src.symbols(data))
    assert both.where("rule_id = 'rust_todo_comment'").count() == 2  # an id in two packs counts twice
    whole = match.detect(data, rules.packs(["shipped"]), mode="file")
    assert ("python_pass_only_function", 2) not in {(r["rule_id"], r["line_no"]) for r in whole.collect()}


def test_limits_of_the_classifier(spark):
    rows = [("x/spec_example_mock.c", ""), ("tests/x.rs", ""), ("/a/tests/x.rs", ""), ("m/test_x.py", "import pytest\ndef test_a():\n  assert 1"), ("a.ts", "wait(1)")]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"]: r["t"] for r in df.select("path", classify.combined(classify.path_part(F.col("path")), classify.content_part(F.col("content"), F.col("path"))).alias("t")).collect()}
    assert got["tests/x.rs"]["confidence"] == 0.1 and not got["tests/x.rs"]["is_test"]
    assert got["/a/tests/x.rs"]["is_test"] and got["/a/tests/x.rs"]["test_type"] == "UnitTest"
    assert got["m/test_x.py"]["confidence"] == 1.0 and got["a.ts"]["confidence"] == 0.3 and not got["a.ts"]["is_test"]
    assert 0.1 + 0.1 + 0.1 > 0.3


def test_lines_and_metrics(spark):
    df = spark.createDataFrame([("a", ""), ("b", "x\r\n\ny"), ("c", "f() {\n((\n))))))\n# z\n"), ("d", "\xa0// c\n")], "path string, content string")
    assert {r["path"]: r["n"] for r in df.select("path", F.size(text.lines(F.col("content"))).alias("n")).collect()} == {"a": 0, "b": 3, "c": 4, "d": 1}
    got = {r["path"]: r for r in score.metrics(df).collect()}
    assert (got["c"]["nesting_depth"], got["c"]["function_count"], got["c"]["comment_ratio"]) == (3, 1, 0.25)
    assert got["d"]["comment_ratio"] == 1.0 and got["a"]["line_count"] == 0


def test_rules_are_checked(tmp_path):
    rule = rules.packs(["shipped"])[0]
    rules.validate(rules.packs())
    with pytest.raises(PlaybookError):
        rules.validate([rule, rule])
    for bad in ("(?=x)y", r"(a)\1", "a++", "("):
        with pytest.raises(InvalidRuleError):
            rules.validate([rules.Rule("a", "A", "Low", "File", bad, "rust", "p")])
    with pytest.raises(NotSupportedError):
        rules.executable([rules.Rule("a", "A", "Low", "File", "q", "rust", "p", kind="AstQuery")])
    rules.dump_playbook(rules.packs(["shipped"], ["rust"]), "Own", "rust", tmp_path / "a.yaml")
    (tmp_path / "b.yml").write_text("name: x")
    warned = []
    got = rules.load_playbooks(tmp_path, warned.append)
    assert [(r.id, r.pattern, r.severity) for r in got] == [(r.id, r.pattern, r.severity) for r in rules.packs(["shipped"], ["rust"])] and len(warned) == 1
    assert rules.load_playbooks(tmp_path / "none") == []


def test_checkpoints(spark, tree, tmp_path):
    points = control.Checkpoints(spark, str(tmp_path / "points"))
    data = src.read(spark, [str(tree / "src")])
    assert points.create("one", data) == 3 and points.list()[0]["file_count"] == 3
    (tree / "src/door.rs").write_text("changed")
    (tree / "src/notes.txt").unlink()
    (tree / "src/new.go").write_text("package a")
    now = src.read(spark, [str(tree / "src")])
    change = points.compare("one", now)
    assert report.diff_text(change, "one", "compact") == "Changes: +1 ~1 -1"
    assert control.changed_files(now, change).count() == 2
    assert not points.delete("one") and points.delete("one", confirm=True)
    with pytest.raises(CheckpointError):
        points.get("one")


def test_learned_rules(spark, tmp_path):
    store = control.LearnedRules(str(tmp_path), control.LearningConfig(max_patterns_per_language=1))
    rule = rules.Rule("", "Own", "High", "File", "zap!", "rust", "learned")
    assert not store.create(rule, 0.5)["success"] and store.playbook("rust") is None
    got = store.create(rule, 0.9)
    assert got["success"] and got["id"].startswith("learned_") and not store.create(rule, 0.9)["success"]
    assert [r.pattern for r in store.playbook("rust")] == ["zap!"]
    stats = {(r["grouped"], r["language"]): r["n"] for r in control.learned_stats(store.table(spark, ["rust"])).collect()}
    assert stats["all", None] == 1 and stats["language", "rust"] == 1
    assert store.delete("rust", got["id"])


def test_gate_and_reports(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert cli.main(["analyze-files", "src", "--format", "compact"]) == 0
    assert "src/door.rs: 6 issues, " in capsys.readouterr().out
    assert cli.main(["analyze-files", "src/door.rs", "-f", "json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["total_files"] == 1 and told["file_results"][0]["language"] == "rust" and told["average_quality_score"] == told["file_results"][0]["quality_score"]
    assert cli.main(["analyze-files", "src", "-d", "-f", "markdown"]) == 0
    assert "| Files analyzed | 3 |" in capsys.readouterr().out
    assert cli.main(["verify-todo", "-t", "t1", "-f", "src/door.rs", "--policy", "reported"]) == 0  # without rules a gate passes
    empty = control.gate(score.summary(spark.createDataFrame([], "path string, issues long, criticals long, score double"))).first()
    assert empty["passed"] and empty["average_quality_score"] == 100


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.rs", "fn a() {}\n// TODO: x", "rust")], "path string, content string, language string").write.parquet(str(tmp_path / "in/one"))
    spark.createDataFrame([("b.rs", "fn b() {\n    unimplemented!()\n}", "rust")], "path string, content string, language string").write.parquet(str(tmp_path / "in/two"))
    stream = spark.readStream.schema("path string, content string, language string").parquet(str(tmp_path / "in/*"))
    watch.watch(stream, rules.packs(["shipped"]), str(tmp_path / "out"), str(tmp_path / "points")).awaitTermination(60)
    assert sorted((r["path"], r["issues"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.rs", 1, 92.0), ("b.rs", 1, 75.0)]


def test_scoped_rules_need_symbols(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}", "rust")], "path string, content string, language string")
    with pytest.raises(ValueError):
        match.match_lines(files, rules.packs(["shipped"]))


def test_places_of_matches(spark):
    rule = rules.Rule("r", "R", "Low", "File", "ab+", "rust", "p")
    body = "xab\né abb ab\n\n  ab"
    files = spark.createDataFrame([("a.rs", body, "rust")], "path string, content string, language string")
    lines = {(r["line_no"], r["column"], r["snippet"]) for r in match.match_lines(files, [rule]).collect()}
    whole = {(r["line_no"], r["column"], r["snippet"]) for r in match.match_whole(files, [rule]).collect()}
    assert lines == {(1, 2, "ab"), (2, 4, "abb"), (2, 8, "ab"), (4, 3, "ab")}
    assert whole == {(1, 2, "ab"), (2, 3, "abb"), (2, 7, "ab"), (4, 3, "ab")}


def test_diff_of_null_contents(spark):
    old = control.snapshot(spark.createDataFrame([("a", None), ("b", None), ("c", "x"), ("d", "x"), ("e", "x")], "path string, content string"))
    new = control.snapshot(spark.createDataFrame([("a", None), ("b", "y"), ("c", None), ("d", "x"), ("f", None)], "path string, content string"))
    assert {(r["path"], r["change"]) for r in control.diff(old, new).collect()} == {("b", "changed"), ("c", "changed"), ("e", "deleted"), ("f", "new")}


def test_snapshots_hold_every_file(spark, tree, monkeypatch, capsys):
    monkeypatch.chdir(tree)
    (tree / ".quillscan").mkdir()
    (tree / ".quillscan/own.json").write_text("{}")
    names = {r["path"].rpartition("/")[2] for r in src.hashed(spark, ["."]).collect()}
    assert names == {"door.rs", "door.py", "notes.txt", ".secret.py", "a.py", "raw.py"}
    assert cli.main(["checkpoint", "create", "-n", "one", "."]) == 0
    (tree / "src/raw.py").write_bytes(b"\xff\xfe\x01")
    capsys.readouterr()
    assert cli.main(["checkpoint", "diff", "one", "."]) == 0 and "raw.py" in capsys.readouterr().out
    assert cli.main(["checkpoint", "list", "-f", "json"]) == 0 and json.loads(capsys.readouterr().out)[0]["file_count"] == 6


def test_gate_leaves_tests_out_and_warns(spark, tree, monkeypatch, capsys):
    import subprocess

    monkeypatch.chdir(tree)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    run("add", "src/door.py")
    run("commit", "-m", "one")
    (tree / "playbooks").mkdir()
    rules.dump_playbook(rules.packs(["shipped"], ["rust", "python"])[:0] + [r for r in rules.packs(["shipped"], ["rust"]) if r.scope == "FunctionBody"], "Own", "rust", tree / "playbooks/own.yaml")
    (tree / "src/door_test.rs").write_text("#[test]\nfn a() {\n    assert!(true);\n    unimplemented!()\n}\n")
    (tree / "src/door.rs").write_text("fn ok() {}\n")
    assert cli.main(["verify-todo", "-t", "t", "-f", "src/door.rs"]) == 0
    said = capsys.readouterr()
    assert "src/door_test.rs" in said.err and "PASSED" in said.out
    (tree / "src/door.rs").write_text(RUST)
    assert cli.main(["verify-todo", "-t", "t", "-f", "src/door.rs", "src/door_test.rs", "--strict"]) == 1
    assert "required: 85" in capsys.readouterr().out


def test_git_changes_of_all_four_kinds(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    for i in range(5):
        (tmp_path / f"c{i}.py").write_text("x")
        run("add", ".")
        run("commit", "-m", str(i))
    (tmp_path / "c0.py").write_text("y")  # changed
    (tmp_path / "s.py").write_text("z")
    run("add", "s.py")  # staged
    (tmp_path / "u.py").write_text("z")  # untracked code
    (tmp_path / "u.md").write_text("z")  # untracked, no code
    got = [r["path"] for r in src.git_changes(spark, str(tmp_path)).collect()]
    assert got == ["c0.py", "c2.py", "c3.py", "c4.py", "s.py", "u.py"]


def test_store_of_learned_rules(tmp_path):
    store = control.LearnedRules(str(tmp_path))
    store.bootstrap()
    assert sum(p.is_dir() for p in tmp_path.rglob("*")) == len(control.FOLDERS) == 16
    (tmp_path / "config/learning-config.json").write_text('{"min_confidence": 0.9}')
    store.bootstrap()
    assert store.config.min_confidence == 0.9 and store.config.max_patterns_per_language == 100
    (tmp_path / "patterns/rust/learned-patterns.json").write_text("[{")
    warned = []
    assert store.rules(["rust"], warned.append) == [] and len(warned) == 1
    (tmp_path / "config/learning-config.json").write_text("[")
    with pytest.raises(ConfigurationError):
        store.bootstrap()


def test_tasks(spark, tmp_path):
    tasks = control.Tasks(str(tmp_path / "t/tasks.json"))
    a, b = tasks.create("one", ["x.rs"]), tasks.create("two", ["y.rs"], max_critical_issues=1)
    results = spark.createDataFrame([("x.rs", 60.0, 1), ("y.rs", 90.0, 1)], "path string, score double, criticals long")
    assert [s["status"] for s in tasks.verify(results)] == ["needs-revision", "completed"]
    assert not tasks.complete(a, results) and tasks.complete(b, results) and tasks.list()[1]["status"] == "completed"


def test_full_assessment_and_advice(spark):
    found = spark.createDataFrame([("a", "r", "Low")], "path string, rule_id string, severity string")
    metrics = spark.createDataFrame([("a", 12, 1, 1, 1, 21.0, [1, 4, 5], 3, 1, 1, 2), ("b", 1, 1, 1, 1, 1.0, None, 0, 0, 0, 0)], "path string, cyclomatic int, cognitive int, npath int, halstead int, average_complexity double, loop_depths array<int>, allocation_hotspots int, leak_risks int, synchronization_issues int, thread_safety_concerns int")
    got = {r["path"]: r for r in score.full_assessment(found, metrics).collect()}
    a = got["a"]
    assert (a["maintainability"], a["performance"], a["reliability"], a["security"], a["completeness"]) == (98 - 8 - 15 - 15, 100 - 10 - 30 - 6, 75, 80, 100)
    assert got["b"]["overall"] == 100
    advice = {r["path"]: r["recommendations"] for r in score.recommendations(metrics).collect()}
    assert len(advice["a"]) == 5 and advice["b"] == []


def test_indicators(spark):
    df = spark.createDataFrame([("a/tests/test_x.py", "import pytest"), ("src/main.rs", "fn main() {}")], "path string, content string")
    got = {r["path"]: r["t"] for r in df.select("path", classify.classified(F.col("content"), F.col("path")).alias("t")).collect()}
    assert got["a/tests/test_x.py"]["should_suppress"] and len(got["a/tests/test_x.py"]["indicators"]) >= 3
    assert got["src/main.rs"]["indicators"] == [] and not got["src/main.rs"]["is_test"]
