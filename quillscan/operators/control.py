"""Checkpoints, gates, tasks and learned rules."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.errors import CheckpointError, ConfigurationError, ParseError, QuillscanError
from quillscan.operators.rules import Rule, check_pattern

# --- checkpoints -----------------------------------------------------------


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, content_hash) and, where there is one, modified_time; one row for a path. Hashed files (sources.files.hashed) are taken as they are."""
    extra = ["modified_time"] if "modified_time" in files.columns else []
    if "content_hash" in files.columns:
        return files.select("path", "size", "content_hash", *extra).dropDuplicates(["path"])
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("string"), 256).alias("content_hash"), *extra).dropDuplicates(["path"])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed or deleted. One full outer join on the path."""
    # a content can be null, so presence is told by markers
    a, b = (x.select("path", F.col("content_hash").alias(h), F.lit(True).alias(m)) for x, h, m in ((old, "was", "had"), (new, "now", "has")))
    change = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def changed_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files to analyse again."""
    return files.join(changes.where("change IN ('new', 'changed')"), "path", "left_semi")


@dataclass
class Checkpoints:
    """A table of snapshots, partitioned by checkpoint, with a header file for each."""

    spark: SparkSession
    base: str

    def _name(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise CheckpointError(f"not a checkpoint name: {name}")
        return name

    def create(self, name: str, files: DataFrame, description: str | None = None) -> int:
        path = f"{self.base}/snapshots/checkpoint={self._name(name)}"
        snapshot(files).write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).count()
        header = Path(f"{self.base}/headers")
        header.mkdir(parents=True, exist_ok=True)
        (header / f"{name}.json").write_text(json.dumps({"name": name, "description": description, "timestamp": datetime.now(timezone.utc).isoformat(), "file_count": n}))
        return n

    def list(self) -> list[dict]:
        found = [json.loads(p.read_text()) for p in Path(f"{self.base}/headers").glob("*.json")]
        return sorted(found, key=lambda x: x["timestamp"], reverse=True)

    def get(self, name: str) -> dict:
        p = Path(f"{self.base}/headers/{self._name(name)}.json")
        if not p.exists():
            raise CheckpointError(f"checkpoint '{name}' not found")
        return json.loads(p.read_text())

    def files(self, name: str) -> DataFrame:
        self.get(name)
        return self.spark.read.parquet(f"{self.base}/snapshots/checkpoint={name}").orderBy("path")

    def compare(self, name: str, files: DataFrame) -> DataFrame:
        return diff(self.files(name), snapshot(files))

    def delete(self, name: str, confirm: bool = False) -> bool:
        import shutil

        if not confirm:
            return False
        self.get(name)
        shutil.rmtree(f"{self.base}/snapshots/checkpoint={name}", ignore_errors=True)
        Path(f"{self.base}/headers/{name}.json").unlink()
        return True


# --- gates and tasks -------------------------------------------------------


def gate(summary: DataFrame, min_quality: float = 80.0, max_critical: int = 0) -> DataFrame:
    """The summary's row with passed. No files: passed with 100."""
    return summary.withColumn("passed", (F.col("average_quality_score") >= min_quality) & (F.col("critical_issues") <= max_critical))


STRICT = {"min_quality": 85.0, "max_critical": 0}


def hidden_files(discovered: DataFrame, reported: DataFrame) -> DataFrame:
    """Changed files that were not reported."""
    return discovered.join(reported, "path", "left_anti")


def gate_files(discovered: DataFrame, reported: DataFrame, policy: str = "git") -> DataFrame:
    """The files a gate looks at: what was discovered (the default, whatever was reported) or what was reported."""
    return (discovered if policy == "git" else reported).select("path").distinct()


def same_list(a: list[str], b: list[str]) -> bool:
    return a == b


def task_states(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """tasks (id, files array, quality_threshold, max_critical_issues) against file results (path, score, criticals): (id, quality, criticals, status, verified)."""
    rows = tasks.select("id", "quality_threshold", "max_critical_issues", F.explode_outer("files").alias("path"))
    each = rows.join(results.select("path", "score", "criticals"), "path", "left")
    sums = each.groupBy("id", "quality_threshold", "max_critical_issues").agg(F.count("path").alias("n"), F.avg("score").alias("score"), F.sum("criticals").alias("criticals"))
    quality, criticals = F.coalesce("score", F.lit(100.0)), F.coalesce("criticals", F.lit(0)).cast("long")
    ok = (quality >= F.col("quality_threshold")) & (criticals <= F.col("max_critical_issues"))
    status = F.when((F.col("n") == 0) | ok, "completed").otherwise("needs-revision")
    return sums.select("id", quality.alias("quality"), criticals.alias("criticals"), status.alias("status"), ((F.col("n") > 0) & ok).alias("verified"))


@dataclass
class Tasks:
    """Tasks (id, title, files, quality_threshold, max_critical_issues, status) in one JSON file."""

    path: str

    def list(self) -> list[dict]:
        return json.loads(Path(self.path).read_text()) if Path(self.path).exists() else []

    def _save(self, tasks: list[dict]) -> None:
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        Path(self.path).write_text(json.dumps(tasks, indent=1))

    def create(self, title: str, files: list[str], quality_threshold: float = 80.0, max_critical_issues: int = 0) -> str:
        new = str(uuid.uuid4())
        self._save([*self.list(), {"id": new, "title": title, "files": files, "quality_threshold": quality_threshold, "max_critical_issues": max_critical_issues, "status": "pending"}])
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t["id"], t["files"], float(t["quality_threshold"]), t["max_critical_issues"]) for t in self.list()]
        return spark.createDataFrame(rows, "id string, files array<string>, quality_threshold double, max_critical_issues int")

    def verify(self, results: DataFrame) -> list[dict]:
        """Every task's state under the file results (path, score, criticals); the states are kept."""
        states = {r["id"]: r.asDict() for r in task_states(self.table(results.sparkSession), results).collect()}
        self._save([t | {"status": states[t["id"]]["status"]} for t in self.list()])
        return [states[t["id"]] for t in self.list()]

    def complete(self, task: str, results: DataFrame) -> bool:
        """Whether the task is complete now: only if its files pass."""
        return any(s["id"] == task and s["status"] == "completed" for s in self.verify(results))


# --- learned rules ---------------------------------------------------------


@dataclass
class LearningConfig:
    min_confidence: float = 0.75
    max_patterns_per_language: int = 100
    auto_validate: bool = True
    pattern_expiry_days: int = 30
    learning_rate: float = 1.0

    @classmethod
    def load(cls, path: Path) -> "LearningConfig":
        """The file's configuration; where there is none, the defaults, which are written there."""
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(asdict(cls()), indent=1))
            return cls()
        try:
            return cls(**json.loads(path.read_text()))
        except (ValueError, TypeError) as e:
            raise ConfigurationError(f"{path}: {e}") from e


#: The folders of a store.
FOLDERS = ("patterns", "patterns/rust", "patterns/python", "patterns/typescript", "patterns/javascript", "patterns/go", "patterns/c", "patterns/cpp", "analysis", "analysis/sessions", "analysis/reports", "analysis/reports/daily", "analysis/reports/weekly", "database", "config", "logs")


LEARNED = "id string, name string, language string, severity string, scope string, pattern string, confidence double, detection_count long, false_positive_count long, active boolean, source string, created_at string"


class LearnedRules:
    """The store of learned rules: one JSON file for each language below base/patterns."""

    def __init__(self, base: str, config: LearningConfig | None = None):
        self.base, self.config = Path(base), config or LearningConfig()

    def bootstrap(self) -> None:
        """Make the store's folders and read its configuration."""
        for name in FOLDERS:
            (self.base / name).mkdir(parents=True, exist_ok=True)
        self.config = LearningConfig.load(self.base / "config" / "learning-config.json")

    def _file(self, language: str) -> Path:
        return self.base / "patterns" / language / "learned-patterns.json"

    def rows(self, language: str) -> list[dict]:
        p = self._file(language)
        try:
            return json.loads(p.read_text()) if p.exists() else []
        except ValueError as e:
            raise ParseError(f"{p}: {e}") from e

    def save(self, language: str, rows: list[dict]) -> None:
        self._file(language).parent.mkdir(parents=True, exist_ok=True)
        self._file(language).write_text(json.dumps(rows, indent=1))

    def check(self, rule: Rule) -> tuple[list[str], list[str]]:
        """(errors, warnings)."""
        errors, warnings = [], []
        try:
            check_pattern(rule)
        except QuillscanError as e:
            errors.append(str(e))
        if any(r["pattern"] == rule.pattern for r in self.rows(rule.language)):
            warnings.append("a rule with this pattern is there already")
        if not rule.examples:
            warnings.append("no examples")
        return errors, warnings

    def create(self, rule: Rule, confidence: float, source: str = "manual") -> dict:
        """A response: success, id, errors, warnings. Rejections are no exceptions."""
        errors, warnings = self.check(rule)
        held = self.rows(rule.language)
        if not errors and confidence < self.config.min_confidence:
            errors.append(f"confidence {confidence} is below {self.config.min_confidence}")
        if not errors and len(held) >= self.config.max_patterns_per_language:
            errors.append("the language's store is full")
        if errors:
            return {"success": False, "id": None, "errors": errors, "warnings": warnings}
        new = "learned_" + str(uuid.uuid4()).replace("-", "_")
        row = {"id": new, "name": rule.name, "language": rule.language, "severity": rule.severity, "scope": rule.scope, "pattern": rule.pattern, "confidence": confidence, "detection_count": 0, "false_positive_count": 0, "active": True, "source": source, "created_at": datetime.now(timezone.utc).isoformat()}
        self.save(rule.language, [*held, row])
        return {"success": True, "id": new, "errors": [], "warnings": warnings}

    def delete(self, language: str, rule_id: str) -> bool:
        held = self.rows(language)
        left = [r for r in held if r["id"] != rule_id]
        self.save(language, left)
        return len(left) < len(held)

    def playbook(self, language: str) -> list[Rule] | None:
        """The active rules, or None if there are none."""
        out = [Rule(r["id"], r["name"], r["severity"], r["scope"], r["pattern"], language, f"learned-{language}") for r in self.rows(language) if r["active"]]
        return out or None

    def rules(self, languages, warn=print) -> list[Rule]:
        """The active rules of all languages. A store that can't be read is warned of and left out: the rules it stands beside still run."""
        try:
            return [r for lang in languages for r in self.playbook(lang) or []]
        except (QuillscanError, OSError, KeyError, TypeError) as e:
            warn(f"learned rules are left out: {e}")
            return []

    def table(self, spark: SparkSession, languages) -> DataFrame:
        names = [x.split()[0] for x in LEARNED.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for lang in languages for r in self.rows(lang)], LEARNED)


def learned_stats(learned: DataFrame) -> DataFrame:
    """(grouped, language, severity, n, mean_confidence, detections) for languages, severities and all."""
    sets = learned.groupingSets([["language"], ["severity"], []], "language", "severity")
    kind = F.when(F.grouping("language") == 0, "language").when(F.grouping("severity") == 0, "severity").otherwise("all")
    rows = sets.agg(kind.alias("grouped"), F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.sum("detection_count"), F.lit(0)).alias("detections"))
    return rows.select("grouped", "language", "severity", "n", "mean_confidence", "detections")


def top_learned(learned: DataFrame, n: int = 10) -> DataFrame:
    return learned.orderBy(F.desc("detection_count"), "name").limit(n)
