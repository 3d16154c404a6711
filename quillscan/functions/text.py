"""Columns over paths, contents and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension, as reported.
BY_EXTENSION = {"rs": "rust", "py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp"}
#: The classifier's; all others are rust there.
CLASSIFIED = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp"}
CODE = ("rs", "py", "ts", "js", "tsx", "jsx", "go", "c", "cpp", "h", "hpp")


def lookup(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the name; null if there is none or it leads the name."""
    out = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), out)


def language(path: Column, forced: str | None = None) -> Column:
    return F.lit(forced) if forced else lookup(F.lower(extension(path)), BY_EXTENSION)


def classified_language(path: Column) -> Column:
    return F.coalesce(lookup(F.lower(extension(path)), CLASSIFIED), F.lit("rust"))


def lines(content: Column) -> Column:
    """Split at line feeds, with one carriage return before each; no empty last line."""
    parts = F.split(content, r"\r?\n", -1)
    return F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))[0]


def exploded(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, line)."""
    rows = files.select(*keep, F.posexplode(lines(F.col("content"))).alias("_at", "line"))
    return rows.select(*keep, (F.col("_at") + 1).alias("line_no"), "line")


def trim_ws(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_comment(line: Column) -> Column:
    """Whether a line counts as a comment for rules: only by how it starts, whatever the language."""
    return line.rlike(r"""(?U)^\s*(//|#|/\*|\*|\"\"\"|''')""")


def is_metric_comment(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*(//|#|/\*)")


def context(rows: DataFrame, around: int = 2) -> DataFrame:
    """path, line_no, line with the lines before and after each, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line_no")
    return rows.withColumns({"before": F.collect_list("line").over(w.rowsBetween(-around, -1)), "after": F.collect_list("line").over(w.rowsBetween(1, around))})


def wanted(files: DataFrame, *, max_bytes: int | None = 10 * 1024 * 1024, extensions: list[str] | None = None, exclude: list[str] = (), include_hidden: bool = True, root: str = "") -> DataFrame:
    """The file filter, cheap conditions first; they reach the scan where the source can use them."""
    if max_bytes is not None:
        files = files.where(F.col("size_bytes") <= max_bytes)
    if extensions is not None:
        files = files.where(F.coalesce(F.lower(extension(F.col("path"))).isin([e.strip().lower().lstrip(".") for e in extensions]), F.lit(False)))
    for part in exclude:
        files = files.where(~F.col("path").contains(part))
    if not include_hidden:
        below = F.regexp_replace("path", "^" + __import__("re").escape(root), "") if root else F.col("path")
        files = files.where(~below.rlike(r"(^|/)\.[^/]+"))
    return files
