"""Files as DataFrames: path, content, size_bytes, modified_time, language."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import text

SCHEMA = "path string, content string, size_bytes long, modified_time timestamp"


def _decoded(raw: DataFrame) -> DataFrame:
    """Contents that are valid UTF-8; others are dropped."""
    rows = raw.where(F.is_valid_utf8(F.col("content").cast("string")))
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"))


def _given(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """Paths as they were given: names maps absolute to given ones."""
    path = F.col("path")
    for whole, given in sorted(names.items()):  # the longest that holds goes last
        if whole != given:
            inside = (F.col("path") == whole) | F.col("path").startswith(whole.rstrip("/") + "/")
            path = F.when(inside, F.concat(F.lit(given.rstrip("/")), F.substring("path", len(whole.rstrip("/")) + 1, 1 << 20))).otherwise(path)
    return found.withColumn("path", path)


def _walked(paths: Sequence[str], store: str | None = None) -> list[str]:
    """All files below local paths, hidden ones too, but for entries of the store's name."""
    out: list[str] = []
    for p in paths:
        if os.path.isfile(p):
            out.append(p)
        for d, folders, names in os.walk(p):
            folders[:] = [x for x in folders if x != store]
            out += [os.path.join(d, x) for x in names if x != store]
    return list(dict.fromkeys(out))


def read(spark: SparkSession, paths: Sequence[str], *, include_hidden: bool = False, extensions: Sequence[str] | None = None, exclude: Sequence[str] = (), max_bytes: int | None = 10 * 1024 * 1024, language: str | None = None, partitions: int | None = None) -> DataFrame:
    """Files and whole directories, in one scan. Files that are named are taken whether hidden or not; missing paths are passed over."""
    local = {os.path.abspath(p): p for p in paths if "://" not in p and os.path.exists(p)}
    folders = [p for p in local if os.path.isdir(p)]
    named = [p for p in local if p not in folders]
    far = [p for p in paths if "://" in p]
    parts = []
    if folders and include_hidden:
        parts.append(from_paths(spark, _walked(folders)))
    elif folders:
        rows = _decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders))
        inside = F.lit(False)
        for p in folders:
            below = F.substring("path", len(p.rstrip("/")) + 1, 1 << 20)
            inside = inside | (F.col("path").startswith(p.rstrip("/") + "/") & ~below.rlike(r"(^|/)\.[^/]+"))
        parts.append(rows.where(inside))
    if named or far:
        parts.append(_decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).load([*named, *far])))
    found = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for rows in parts[1:]:
        found = found.unionByName(rows)
    found = _given(found, local)
    found = text.wanted(found, max_bytes=max_bytes, extensions=list(extensions) if extensions is not None else None, exclude=list(exclude))
    found = found.dropDuplicates(["path"]) if len(paths) > 1 else found
    found = found.repartition(partitions) if partitions else found  # files are small and uneven: deal them out before the expressions run
    return found.withColumn("language", text.language(F.col("path"), language))


def hashed(spark: SparkSession, paths: Sequence[str], store: str = ".quillscan") -> DataFrame:
    """(path, size, content_hash, modified_time) of all files below the paths, whatever their size, name or encoding, but for what is in the store. For snapshots; contents are read in pieces and stay with the executors."""
    here = {os.path.abspath(p): p for p in paths if "://" not in p and os.path.exists(p)}
    schema = "path string, size long, content_hash string, modified_time timestamp"

    def work(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            rows = []
            for p in batch["path"]:
                try:
                    digest = hashlib.sha256()
                    with open(p, "rb") as f:
                        while part := f.read(1 << 20):
                            digest.update(part)
                    s = os.stat(p)
                    rows.append((p, s.st_size, digest.hexdigest(), pd.Timestamp(s.st_mtime_ns // 1000, unit="us")))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "size", "content_hash", "modified_time"]).astype({"modified_time": "datetime64[us]"})

    found = spark.createDataFrame([(p,) for p in _walked(list(here), store)], "path string").mapInPandas(work, schema)
    found = _given(found, here)
    if far := [p for p in paths if "://" in p]:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(far).where(~F.col("path").contains(f"/{store}/"))
        found = found.unionByName(rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_time")))
    return found


def from_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Named files read by the executors, hidden ones too; unreadable and non-UTF-8 files are dropped."""

    def load(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for p in batch["path"]:
                try:
                    with open(p, encoding="utf-8", newline="") as f:
                        body = f.read()
                    s = os.stat(p)
                    rows.append((p, body, s.st_size, pd.Timestamp(s.st_mtime_ns // 1000, unit="us")))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "content", "size_bytes", "modified_time"]).astype({"modified_time": "datetime64[us]"})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(load, SCHEMA)


def from_table(rows: DataFrame, path: str, content: str, language: str | None = None) -> DataFrame:
    """Any table as files."""
    out = rows.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return out.withColumns({"size_bytes": F.octet_length("content").cast("long"), "language": text.language(F.col("path"), language)})


def git_changes(spark: SparkSession, root: str = ".") -> DataFrame:
    """(path): changed, staged, changed in the last three commits, and untracked code files; sorted, once each, that exist."""

    def lines(*args: str) -> list[str]:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        return [x for x in done.stdout.split("\n") if x.strip()] if done.returncode == 0 else []

    names = {*lines("diff", "--name-only"), *lines("diff", "--cached", "--name-only"), *lines("diff", "--name-only", "HEAD~3")}
    names |= {x for x in lines("ls-files", "--others", "--exclude-standard") if x.rpartition(".")[2] in text.CODE}
    return spark.createDataFrame([(n,) for n in sorted(names) if os.path.exists(os.path.join(root, n))], "path string")


def symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line) of functions and classes.

    An approximation by layout: Python blocks end before the next line that is indented no deeper, brace languages where the braces that open after a header balance.
    """

    def work(batches):
        import pandas as pd

        head_py = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
        head = re.compile(r"^\s*(?:(?:pub(?:\([^)]*\))?|export|default|async|unsafe|static|const|public|private|protected|inline|extern)\s+)*(?:(fn|func|function|class|struct|impl|trait)\b\s*(?:\([^)]*\)\s*)?(\w*)|[\w:<>*&\s]+?\b(\w+)\s*\([^;]*\)\s*(?::[^{;]*)?\{)")
        skip = ("if", "for", "while", "switch", "match", "catch", "return", "else")
        for batch in batches:
            out = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                rows, held, last = content.split("\n"), [], 0  # held: [kind, name, start, depth, whether its braces have opened]
                close = lambda s, end: out.append((path, s[0], s[1], s[2], end))  # noqa: E731, B023
                depth = 0
                for i, line in enumerate(rows, 1):
                    if language == "python":
                        if line.strip():
                            indent = len(line) - len(line.lstrip())
                            while held and indent <= held[-1][3]:
                                close(held.pop(), last)
                            last = i
                        if m := head_py.match(line):
                            held.append(["class" if m[2] == "class" else "method" if m[1] else "function", m[3], i, len(m[1])])
                            last = i
                        continue
                    if (m := head.match(line)) and (m[1] or m[3] not in skip):
                        kind = {"class": "class", "struct": "struct", "impl": "impl", "trait": "trait"}.get(m[1] or "", "function")
                        held.append([kind, m[2] or m[3] or "", i, depth, False])
                    depth += line.count("{") - line.count("}")
                    if "{" in line:
                        for s in held:
                            s[4] = True
                    done = [s[4] and depth <= s[3] or not s[4] and ";" in line for s in held]
                    for s in [s for s, end in zip(held, done) if end]:
                        close(s, i)
                    held = [s for s, end in zip(held, done) if not end]
                for s in reversed(held):
                    close(s, last or s[2]) if language == "python" else close(s, len(rows))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "start_line", "end_line"])

    rows = files.where("language IS NOT NULL").select("path", "content", "language")
    return rows.mapInPandas(work, "path string, kind string, name string, start_line int, end_line int")
