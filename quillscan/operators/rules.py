"""Rules and playbooks: data model, YAML, validation, dialect, selection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.errors import InvalidRuleError, NotSupportedError, PlaybookError
from quillscan.operators import rulepacks

# Fixed values.
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
PENALTY = {"Critical": 25, "High": 15, "Medium": 8, "Low": 3, "Info": 1}
SCOPES = ("File", "FunctionBody", "ClassBody", "Comments", "MethodSignature")
LANGUAGES = ("rust", "python", "javascript", "typescript", "go", "c", "cpp")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    scope: str
    pattern: str
    language: str
    playbook: str
    flags: str | None = None
    description: str = ""
    enabled: bool = True
    tags: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    false_positives: tuple[str, ...] = ()
    kind: str = "Regex"
    guard: str | None = None
    parameters: dict = field(default_factory=dict, compare=False)


def packs(names=("builtin", "shipped"), languages=LANGUAGES) -> list[Rule]:
    """The built-in and shipped rules, in playbook order; an id that is in both is there twice, as a run loads both."""
    out = []
    for pack in names:
        for language, rows in {"builtin": rulepacks.BUILTIN, "shipped": rulepacks.SHIPPED}[pack].items():
            if language in languages:
                out += [Rule(i, n, sev, scope, pattern, language, f"{pack}-{language}", flags, f"Finds: {n}.", True, tuple(tags), guard=guard) for i, n, sev, scope, flags, pattern, tags, guard in rows]
    return out


def dialect(rule: Rule, whole_file: bool = False, honor_flags: bool = False) -> str:
    """The rule's pattern for java.util.regex. Look-around, back-references and possessive or atomic groups are refused: a rule that needs them is not valid."""
    pattern = rule.pattern
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|(?<!\\)[*+?}]\+", pattern):
        raise InvalidRuleError(f"{rule.id}: not a linear-time pattern")
    pattern = pattern.replace("(?i)", "(?iu)")
    if whole_file:
        pattern = re.sub(r"(?<!\\)\$", r"\\z", pattern)
    flags = "".join(f for f in (rule.flags or "") if f in "imsx") if honor_flags else ""
    return f"(?dU{flags}{'u' if 'i' in flags else ''}){pattern}"


def validate(rules: list[Rule]) -> None:
    """Ids are unique within a playbook, languages known, patterns compile."""
    seen = set()
    for r in rules:
        if (r.playbook, r.id) in seen:
            raise PlaybookError(f"duplicate rule id: {r.id}")
        seen.add((r.playbook, r.id))
        if r.language not in LANGUAGES:
            raise PlaybookError(f"unknown language: {r.language}")
        if r.severity not in SEVERITIES or r.scope not in SCOPES:
            raise InvalidRuleError(f"{r.id}: unknown severity or scope")
        if r.kind == "Regex":
            check_pattern(r)


def check_pattern(rule: Rule) -> None:
    pattern = re.sub(r"(?<!^)\(\?i\)(.*)$", r"(?i:\1)", rule.pattern)
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise InvalidRuleError(f"{rule.id}: {e}") from e
    if compiled.search("") is not None:
        raise InvalidRuleError(f"{rule.id}: the pattern matches empty text")
    dialect(rule)


def executable(rules: list[Rule]) -> list[Rule]:
    """Enabled rules; other kinds than Regex are refused."""
    for r in rules:
        if r.enabled and r.kind != "Regex":
            raise NotSupportedError(f"{r.id}: {r.kind} patterns are not run")
    return [r for r in rules if r.enabled]


def for_language(rules: list[Rule], language: str) -> list[Rule]:
    return [r for r in executable(rules) if r.language == language]


def _yaml():
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    for kind in ("Regex", "AstQuery", "Structural"):
        Loader.add_constructor(f"!{kind}", lambda loader, node, kind=kind: {"kind": kind, **loader.construct_mapping(node, deep=True)})
    return yaml, Loader


REQUIRED = ("id", "name", "description", "severity", "pattern_type", "scope", "enabled", "tags", "examples", "false_positives")


def load_playbook(path: str | Path) -> list[Rule]:
    """One YAML playbook."""
    yaml, loader = _yaml()
    try:
        data = yaml.load(Path(path).read_text(encoding="utf-8"), loader)
    except (OSError, yaml.YAMLError, UnicodeDecodeError) as e:
        raise PlaybookError(f"{path}: {e}") from e
    for key in ("name", "version", "language", "author", "description", "metadata", "rules"):
        if not isinstance(data, dict) or key not in data:
            raise PlaybookError(f"{path}: no {key}")
    out = []
    for row in data["rules"]:
        if missing := [k for k in REQUIRED if k not in row]:
            raise PlaybookError(f"{path}: a rule lacks {', '.join(missing)}")
        kind = row["pattern_type"]
        out.append(Rule(row["id"], row["name"], row["severity"], row["scope"], kind.get("pattern") or kind.get("query") or "", data["language"].lower(), str(path), kind.get("flags"), row["description"], row["enabled"], tuple(row["tags"]), tuple(row["examples"]), tuple(row["false_positives"]), kind["kind"], None, kind.get("parameters") or {}))
    validate(out)
    return out


def load_playbooks(directory: str | Path, warn=print) -> list[Rule]:
    """All *.yaml and *.yml in a directory, not below it; a bad file is warned of and skipped, a missing directory is empty."""
    out: list[Rule] = []
    for p in sorted(Path(directory).glob("*")) if Path(directory).is_dir() else []:
        if p.suffix in (".yaml", ".yml"):
            try:
                out += load_playbook(p)
            except PlaybookError as e:
                warn(f"skipped {p}: {e}")
    return out


def dump_playbook(rules: list[Rule], name: str, language: str, path: str | Path) -> None:
    import json

    lines = [f"name: {json.dumps(name)}", 'version: "1.0.0"', f"language: {language}", 'author: "quillscan"', f"description: {json.dumps(name)}", "metadata: {}", "rules:"]
    for r in rules:
        lines += [f"  - id: {json.dumps(r.id)}", f"    name: {json.dumps(r.name)}", f"    description: {json.dumps(r.description)}", f"    severity: {r.severity}", "    pattern_type: !Regex", f"      pattern: {json.dumps(r.pattern)}"]
        lines += [f"      flags: {json.dumps(r.flags)}"] * bool(r.flags)
        lines += [f"    scope: {r.scope}", f"    enabled: {str(r.enabled).lower()}", f"    tags: {json.dumps(list(r.tags))}", f"    examples: {json.dumps(list(r.examples))}", f"    false_positives: {json.dumps(list(r.false_positives))}"]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(seq, id, name, severity, scope, flags, pattern, language, playbook, enabled, tags)."""
    rows = [(i, r.id, r.name, r.severity, r.scope, r.flags, r.pattern, r.language, r.playbook, r.enabled, list(r.tags)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "seq int, id string, name string, severity string, scope string, flags string, pattern string, language string, playbook string, enabled boolean, tags array<string>")


def duplicates(table: DataFrame, *by: str) -> DataFrame:
    """Ids that occur more than once (within each value of by)."""
    return table.groupBy(*by, "id").agg(F.count("*").alias("n")).where("n > 1")


def with_id(rule: Rule, new: str) -> Rule:
    return replace(rule, id=new)
