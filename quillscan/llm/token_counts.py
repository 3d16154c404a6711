"""Exact length histogram of a corpus, and what its suffix sums answer.

Documents are encoded once; each batch leaves only (length, documents) pairs,
which are summed by length. Suffix sums over the histogram then answer, for any
context limit, how many documents and tokens a truncation keeps. The sums are
taken in two levels (blocks of lengths, then lengths within a block), so no task
sees more than one block or one row for each block.

Nulls count as empty texts (length 0), repeated rows count each, an empty table
gives an empty histogram, and no other column than the text is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm import tok
from quillscan.llm.common import ship, stash, text_of

BLOCK = 1024


def length_histogram(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None, kind: str = "byte", end_tokens: int = 0) -> DataFrame:
    """(length long, n_docs long): how many documents have each encoded length, end_tokens included."""
    ship(docs.sparkSession)
    path = vocabulary or tok.vocabulary("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tok.opened(kind, path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = [len(x) // 4 + end_tokens for a, b in tok.portions(texts) for x in model.encode(texts[a:b])]
            lengths, n = np.unique(np.array(sizes, "i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(n.astype("i8"))], ["length", "n"])

    counted = docs.select(text_of(text).alias("t")).mapInArrow(count, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    n_tokens            tokens of the documents of length L
    docs_longer         documents longer than L (those that are truncated)
    tokens_longer       tokens of those documents
    docs_upto           documents of at most L tokens
    tokens_upto         tokens of those
    truncated_total     tokens that are left if each document is cut to L
    """
    hist = stash(hist, "histogram")  # read twice below, made once
    rows = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).cast("long").alias("block"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c, later: (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(later)).cast("long")
    out = rows.join(blocks, "block").withColumns({"docs_longer": longer("n_docs", "later_docs"), "tokens_longer": longer("n_tokens", "later_tokens")})
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_longer",
        "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).cast("long").alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_longer")).cast("long").alias("tokens_upto"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).cast("long").alias("truncated_total"),
    )


def answer(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """(limit, docs_cut, tokens_kept, tokens_cut) for any context limits, also between the lengths that occur."""
    limits = [int(x) for x in limits]
    # what holds at a limit is what holds at the largest length that is no larger
    best = [F.max(F.when(F.col("length") <= x, F.struct("length", "docs_longer", "tokens_upto"))).alias(f"s{i}") for i, x in enumerate(limits)]
    row = sums.agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"), *best)
    longer = lambda i: F.coalesce(F.col(f"s{i}.docs_longer"), F.col("d"), F.lit(0))
    kept = lambda i, x: F.coalesce(F.col(f"s{i}.tokens_upto"), F.lit(0)) + F.lit(x) * longer(i)
    answers = [F.struct(F.lit(x).cast("long").alias("limit"), longer(i).cast("long").alias("docs_cut"), kept(i, x).cast("long").alias("tokens_kept"), (F.coalesce("t", F.lit(0)) - kept(i, x)).cast("long").alias("tokens_cut")) for i, x in enumerate(limits)]
    return row.select(F.explode(F.array(*answers)).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """(share, length): the least length L such that at least that share of the documents has at most L tokens."""
    picks = [F.min(F.when(F.col("docs_upto") >= F.lit(float(q)) * (F.col("docs_upto") + F.col("docs_longer")), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    shares = list(shares)
    row = sums.agg(*picks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
