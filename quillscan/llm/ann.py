"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional code words, one from each
codebook. Codebooks start from k-means on residuals and are refitted jointly by
least squares; a beam search picks a vector's words. The index keeps for every
row its words, the norm of their sum, and the vector.

A search has two passes. The first sends codes only: it scores all rows by table
lookup, in cells of a block of queries with a block of rows. Rows fall on blocks
by a hash, so a cell holds its share of a query's best rows but for chance; it
returns that share and 6 deviations more. Of these the best `shortlist` of each
query over all rows go on, ties of the last included. The second pass ranks them
by the exact measure in double precision, where the vectors are. Neighbours
outside the shortlist are lost (README has the recall). A task's memory is bounded
by the two block sizes.

Rows that hold one and the same vector are thinned to the k + 1 smallest ids
before the search, the only ones that can be among the k nearest, so copies can't
crowd out others; each task thins its own before they are shuffled.

The codebooks are fitted on at most sample_rows rows, those with the smallest
hashes of their ids; every row is indexed. Vectors that are null, empty or zero,
or hold null or non-finite components, or are not of the most frequent length,
take no part. Repeated ids count as one row's id: such rows are no candidates of
each other. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import drop, sampled, ship, stash


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words of each, dimensions), float32
    beam: int

    def encode(self, x: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """(rows, books) uint8."""
        return np.concatenate([self._encode(x[i : i + at_once]) for i in range(0, len(x), at_once)] or [np.zeros((0, len(self.words)), "u1")])

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        left, codes = x[:, None, :].astype("f4"), np.zeros((n, 1, 0), "u1")
        for book in self.words:
            k, width = len(book), left.shape[1]
            err = np.einsum("nbd,nbd->nb", left, left)[:, :, None] - 2 * (left.reshape(-1, d) @ book.T).reshape(n, width, k) + np.einsum("kd,kd->k", book, book)
            flat, keep = err.reshape(n, -1), min(self.beam, width * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            row, word = best // k, best % k
            left = np.take_along_axis(left, row[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype("u1")], axis=2)
        err = np.einsum("nbd,nbd->nb", left, left)
        return codes[np.arange(n), err.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum((book[codes[:, m]] for m, book in enumerate(self.words)), np.zeros((len(codes), self.words.shape[2]), "f4"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype("f4")


def fit(x: np.ndarray, *, books: int = 12, words: int = 256, beam: int = 4, rounds: int = 6, refits: int = 2, seed: int = 7) -> Codebooks:
    words = min(words, max(8, len(x) // 8))  # a word needs rows to be fitted on
    rng, left, made = np.random.default_rng(seed), x.astype("f4"), []
    for _ in range(books):
        made.append(_kmeans(left, words, rng, rounds))
        left = left - made[-1][((made[-1] ** 2).sum(1) - 2 * left @ made[-1].T).argmin(1)]
    out = Codebooks(np.stack(made), beam)
    for _ in range(refits):  # all codebooks at once: least squares on the words that the beam search picks
        used = out.encode(x).astype("i8")
        size = books * words
        both, target = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for a in range(books):
            np.add.at(target, used[:, a] + a * words, x)
            for b in range(books):
                together = np.bincount(used[:, a] * words + used[:, b], minlength=words * words).reshape(words, words)
                both[a * words : (a + 1) * words, b * words : (b + 1) * words] = together
        prior = out.words.reshape(size, -1)
        out.words = np.linalg.solve(both + np.eye(size), target + prior).reshape(out.words.shape).astype("f4")
    return out


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = 16384, **fitting) -> tuple[DataFrame, Codebooks | None]:
    """The index (row long, vec_id, vec array<float>, codes binary, norm float: the squared norm of the approximation) and its codebooks. row is unique."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "row long, vec_id long, vec array<float>, codes binary, norm float"
    if not size:
        return vectors.sparkSession.createDataFrame([], schema), None
    rows = rows.where(F.size("vec") == size[0]["d"])
    sample = sampled(rows, F.xxhash64("vec_id"), sample_rows).select("vec").toArrow()["vec"].combine_chunks()
    books = fit(np.asarray(sample.flatten(), "f4").reshape(len(sample), -1), **fitting)

    def work(batches):
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), "f4").reshape(batch.num_rows, -1)
            codes = books.encode(x)
            norm = (books.decode(codes) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], "binary"), pa.array(norm.astype("f4"))], ["row", "vec_id", "vec", "codes", "norm"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")
    return stash(numbered.mapInArrow(work, schema), "index"), books


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return np.asarray(whole.flatten(), "f8").reshape(len(whole), -1)


def _lists(values: list[np.ndarray], dtype: str) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, dtype)]).astype(dtype)))


def looked_up(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: Codebooks, keep: int, metric: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query the places and scores of the best rows by table lookup."""
    places, scores, n = [], [], min(keep, len(codes))
    columns = [np.ascontiguousarray(codes[:, m]) for m in range(codes.shape[1])]
    for i in range(0, len(queries), 64):
        tables = np.einsum("qd,mkd->mqk", queries[i : i + 64].astype("f4"), books.words)
        score = tables[0].take(columns[0], axis=1)
        for m in range(1, len(tables)):
            score += tables[m].take(columns[m], axis=1)
        if metric == "l2":
            score = 2 * score - norms
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        places += list(best)
        scores += list(np.take_along_axis(score, best, 1))
    return places, scores


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, *, k: int = 20, shortlist: int = 640, row_block: int = 8192, query_block: int = 4096, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, vec) its k nearest rows of the index.

    metric: ip, the inner product, or l2, the negative squared distance. shortlist: how many rows of all are ranked exactly for a query.
    """
    spark, schema = index.sparkSession, "query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copies = Window.partitionBy("vec").orderBy("vec_id", "row")
    rows = index.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
    queries = stash(queries.select(F.col("vec_id").alias("query_id"), "vec").dropDuplicates(["query_id"]), "queries")
    row_blocks, query_blocks = -(-index.count() // row_block) or 1, -(-queries.count() // query_block) or 1
    share = max(shortlist, k + 1) / row_blocks
    keep = math.ceil(share + 6 * math.sqrt(share) + 8) if row_blocks > 1 else max(shortlist, k + 1)
    number = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    deal = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")
    rows = stash(rows.withColumn("rb", deal("row", row_blocks)), "rows")

    def first(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.table({"query_id": pa.array([], "int64"), "rb": pa.array([], "int32"), "rows": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float32()))})
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), "u1").reshape(held.num_rows, -1)
        number_of = np.asarray(held["row"])
        places, scores = looked_up(_matrix(asked["vec"]), codes, np.asarray(held["norm"], "f4"), books, keep, metric)
        return pa.table({"query_id": asked["query_id"], "rb": pa.array(np.full(asked.num_rows, key[1].as_py(), "i4")), "rows": _lists([number_of[p] for p in places], "i8"), "scores": _lists(scores, "f4")})

    left = queries.select("query_id", "vec", deal("query_id", query_blocks).alias("qb"), number(row_blocks).alias("rb"))
    right = rows.select("row", "codes", "norm", "rb", number(query_blocks).alias("qb"))
    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(first, "query_id long, rb int, rows array<long>, scores array<float>")
    near = stash(near, "near")
    # a query's lists hold few more than the shortlist in all
    ranked = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
    cuts = near.groupBy("query_id").agg(F.coalesce(F.get(ranked, F.lit(max(shortlist, k + 1) - 1)), F.lit(float("-inf")).cast("float")).alias("cut"))

    def second(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "float64")})
        numbers, ids, vectors = np.asarray(held["row"]), np.asarray(held["vec_id"]), _matrix(held["vec"])
        order = np.argsort(numbers)
        lists, cut = asked["rows"].combine_chunks(), np.asarray(asked["cut"])
        sizes = np.asarray(lists.value_lengths())
        query = np.repeat(np.arange(asked.num_rows), sizes)
        good = np.asarray(asked["scores"].combine_chunks().flatten()) >= cut[query]
        query, place = query[good], order[np.searchsorted(numbers[order], np.asarray(lists.flatten())[good])]
        asked_ids, asked_vectors = np.asarray(asked["query_id"]), _matrix(asked["vec"])
        other = ids[place] != asked_ids[query]
        query, place = query[other], place[other]
        exact = np.empty(len(query))
        for i in range(0, len(query), 65536):
            x, q = vectors[place[i : i + 65536]], asked_vectors[query[i : i + 65536]]
            exact[i : i + 65536] = np.einsum("pd,pd->p", x, q) if metric == "ip" else -((x - q) ** 2).sum(1)
        by = np.lexsort((ids[place], -exact, query))
        query, place, exact = query[by], place[by], exact[by]
        begin = np.searchsorted(query, np.arange(asked.num_rows))
        stay = np.arange(len(query)) - begin[query] < k
        return pa.table({"query_id": asked_ids[query[stay]], "vec_id": ids[place[stay]], "score": exact[stay]})

    left = near.join(cuts, "query_id").join(queries, "query_id").withColumn("qb", deal("query_id", query_blocks))
    right = rows.select("row", "vec_id", "vec", "rb", number(query_blocks).alias("qb"))
    found = stash(left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(second, schema), "nearest")
    drop(near, queries, rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
