"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a condition on figures of a document (words, symbols, repeated lines and
so on) that rejects it. On a sample (the sample_rows different texts with the
smallest hashes) each figure's cost is timed, less what an empty pass takes, and
one pass counts which rules reject which texts. Rules are then put in order: next
comes the one that rejects most of what the rules before it leave, for the cost of
the figures that these have not computed yet. A document leaves at the first rule
that rejects it, and figures that only later rules need are not computed for it;
figures that several rules need are computed once. The order changes the time,
never the verdict.

Null texts count as empty and are rejected (no words); texts are judged whole,
however long; repeated rows are judged each; rules of equal value keep their given
order; an empty table gives no rows, and rules then keep their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import SPACE, WORD, drop, sampled, stash, text_of

SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # a lambda's variable is evaluated once, where an expression used twice would be twice
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def n_repeat_words(text: Column) -> Column:
    return _repeat_words(words(text))


def _repeat_words(found: Column) -> Column:
    """Words inside a window of three that occurs twice or more. Windows are compared by 64-bit hashes, sorted with their places."""
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        spots = F.when(F.size(h) >= 3, F.sequence(F.lit(0), F.size(h) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        alike = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, alike), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    once = lambda value, f: F.transform(F.array(value), f)[0]
    some = lambda w: F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) < F.size(w)
    return once(hashes, lambda h: once(windows(h), lambda w: F.when(some(w), once(F.sort_array(w), lambda s: covered(repeated(s)))).otherwise(F.lit(0).cast("long"))))


def _upper_share(text: Column) -> Column:
    """Upper-case letters in a hundred letters (of those that have a case)."""
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    lower = F.length(F.regexp_replace(text, r"\P{Ll}+", ""))
    return F.coalesce(100 * upper / F.when(upper + lower > 0, upper + lower), F.lit(0))


def _n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


#: What rules are stated in.
FIGURES: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": _n_lines, "upper_share": _upper_share}
#: Rules that reject: name, the figures that it needs, and the condition on these. The first two are the base; the rest are the cascade's own.
RULES = (
    ("few_words", ("n_words",), lambda f: f["n_words"] < 50),
    ("repeated_words", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    ("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    ("repeated_lines", ("n_dup_lines", "n_lines"), lambda f: 100 * f["n_dup_lines"] > 30 * f["n_lines"]),
    ("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    ("shouting", ("upper_share",), lambda f: f["upper_share"] > 50),
)
LEAST = 1e-3  #: of the cost of a pass over the sample, in seconds: what a comparison of known figures counts


def in_order(costs: dict[str, float], masks: dict[str, int], rules: Sequence = RULES) -> list[tuple[str, float, float]]:
    """(rule, share rejected of what is left, cost): the order by rejections per cost. masks: how many texts are rejected by which rules, a 1 at each of these."""
    left, known, out = dict(masks), set(), []
    rest = list(range(len(rules)))
    while rest:
        total = sum(left.values())
        value = []
        for i in rest:
            cost = LEAST + sum(costs[c] for c in rules[i][1] if c not in known)
            gone = sum(n for m, n in left.items() if m[i] == "1")
            value.append((-gone / cost, cost if not gone else 0.0, i, gone / total if total else 0.0, cost))
        _, _, i, share, cost = min(value)
        out.append((rules[i][0], share, cost))
        known.update(rules[i][1])
        left = {m: n for m, n in left.items() if m[i] != "1"}
        rest.remove(i)
    return out


def ordered(docs: DataFrame, *, text: str = "text", rules: Sequence = RULES, sample_rows: int = 2048) -> list[tuple[str, float, float]]:
    """(rule, share rejected of what the rules before leave, seconds on the sample), in the order in which the cascade runs them."""
    made = stash(sampled(docs.select(text_of(text).alias("t")), F.xxhash64("t"), sample_rows), "sample")
    sample = made.cache()
    try:
        if not sample.count():
            return [(name, 0.0, 0.0) for name, *_ in rules]

        def seconds(figure: Column) -> float:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                sample.agg(F.max(figure)).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        t = F.col("t")
        empty = seconds(F.octet_length(t))
        costs = {name: max(0.0, seconds(FIGURES[name](t)) - empty) for name in dict.fromkeys(c for _, needs, _ in rules for c in needs)}
        mask = F.concat(*[F.when(rejects(t, [r[0]], rules).isNotNull(), "1").otherwise("0") for r in rules])
        masks = {r["m"]: r["count"] for r in sample.groupBy(mask.alias("m")).count().collect()}  # 2 ** len(rules) rows at most
    finally:
        sample.unpersist()
        drop(made)
    return in_order(costs, masks, rules)


def rejects(text: Column, order: Sequence[str], rules: Sequence = RULES, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule in this order that rejects the text, else null. known: figures that are there already; others are computed where they are first needed, once."""
    by_name = {name: (needs, condition) for name, needs, condition in rules}

    def rule(i: int, held: dict[str, Column]) -> Column:
        if i == len(order):
            return F.lit(None).cast("string")
        needs, condition = by_name[order[i]]
        new = [c for c in needs if c not in held]
        test = lambda f: F.when(condition(f), F.lit(order[i])).otherwise(rule(i + 1, f))
        if not new:
            return test(held)
        return F.transform(F.array(F.struct(*[FIGURES[c](text).alias(c) for c in new])), lambda x: test({**held, **{c: x[c] for c in new}}))[0]

    return rule(0, dict(known or {}))


def judge(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns in keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. These figures are computed for all; the cascade's other figures where its order needs them."""
    order = [name for name, *_ in ordered(docs, text=text)]
    t = F.col("t")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), text_of(text).alias("t"))
    by_words = F.transform(F.array(words(t)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))[0]
    rows = rows.select("row", "t", by_words.alias("w"), *[FIGURES[c](t).alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")])
    figures = {"n_words": F.col("w.n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": F.col("w.n_repeat_words")}
    base = [condition(figures) for _, _, condition in RULES[:2]]
    found = F.struct(*[v.alias(c) for c, v in figures.items()], (base[0] | base[1]).alias("base_failed"), rejects(t, order, known=figures).isNull().alias("kept"))
    rows = rows.select("row", found.alias("found"))
    return rows.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], *[F.col("found")[c].alias(c) for c in (*figures, "base_failed", "kept")])


def kept(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that no rule rejects; a document's later rules are not evaluated."""
    order = [name for name, *_ in ordered(docs, text=text)]
    return docs.where(rejects(text_of(text), order).isNull())


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, t, ws, len(ws) AS n, ls, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl,
  [ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] FOR i IN range(1, len(ws) - 1)] AS gs FROM w),
p AS (SELECT row, i FROM (SELECT doc_id AS row, gs, unnest(gs) AS x, unnest(range(1, len(gs) + 1)) AS i FROM g)
  QUALIFY count(*) OVER (PARTITION BY row, x) > 1),
c AS (SELECT row, count(DISTINCT j) AS n_repeat FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY row),
f AS (SELECT doc_id, n::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(ls) AS lines,
  length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS up, length(regexp_replace(t, '\P{Ll}+', '', 'g')) AS low
  FROM g LEFT JOIN c ON row = doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (up + low > 0 AND 100 * up > 50 * (up + low))) AS kept
FROM f
"""
