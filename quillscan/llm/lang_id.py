"""Language identification by fused evidence.

Three kinds of evidence on a page's language are joined by Bayes' rule: the
likelihood of its text under hashed letter trigrams; the language that its
markup declares, by how often each language's pages declare what; and its host.
A host's prior is smoothed towards that of its domain, the domain's towards that
of the address suffix, the suffix's towards all pages'. The counts behind these
are sums of the pages' text posteriors, taken by grouped aggregation over all
pages, and every page leaves its own share out of the counts that judge it.

The languages are all that label a row (1000 at most). The text model is fitted on
at most sample_rows of the different labelled texts, as many of each language and
16 at least, those with the smallest hashes; executors count their trigrams, over
whole texts, and the driver receives counts only. Trigrams overlap, so a text
counts as at most EVIDENCE of them.

A null or empty page has a flat text likelihood and is judged by the rest; pages
are read whole, however long; ties go to the first language in order of code
points; repeated rows are judged each; an empty table gives no rows. Without a
labelled row fit() raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import ship, stash

BUCKETS, EVIDENCE, PRIOR, MOST_LANGUAGES = 1 << 14, 60.0, 5.0, 1000
_TAGS = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
_ENTITY = re.compile(r"&#?\w{1,31};")
_DECLARED = re.compile(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,8})""")
_HOST = re.compile(r"://([^/?#]*)")


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # (languages, BUCKETS)

    def scores(self, text: str) -> np.ndarray:
        grams = trigrams(text)
        if not len(grams):
            return np.zeros(len(self.languages))
        return self.logs[:, grams].mean(1) * min(len(grams), EVIDENCE)

    def predict(self, text: str) -> str:
        return self.languages[int(self.scores(text).argmax())]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of letters in lower case, words set apart by single blanks."""
    codes = np.frombuffer(f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    if len(codes) < 3:
        return np.zeros(0, "i8")
    x = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    return ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(50)).astype("i8")


def visible(html: str) -> str:
    """A page's text without tags, scripts, styles and comments."""
    return _ENTITY.sub(" ", _TAGS.sub(" ", html))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_rows: int = 4096) -> TextModel:
    ship(docs.sparkSession)
    labelled = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("l IS NOT NULL AND length(t) > 0").withColumn("h", F.xxhash64("t", "l"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes or len(sizes) > MOST_LANGUAGES:
        raise ValueError("no labelled rows" if not sizes else f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    most = max(16, sample_rows // len(languages))
    # about twice as many as are wanted pass a threshold on the hash in the scan
    least = {name: -(1 << 63) + (min(2 * most + 100, n) << 64) // n for name, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for name in languages for x in (name, min(least[name], (1 << 63) - 1))])
    rows = labelled.where(F.col("h") <= limit[F.col("l")]).dropDuplicates(["h"])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[name] = held.get(name, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), "string"), pa.array([x.astype("<i8").tobytes() for x in held.values()], "binary")], ["l", "counts"])

    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in rows.select("t", "l").mapInArrow(count, "l string, counts binary").toLocalIterator():
        counts[languages.index(r["l"])] += np.frombuffer(r["counts"], "<i8")
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)).astype("f4"))


def _read(model: TextModel):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hosts = [m[1].lower().split("@")[-1].split(":")[0].strip(".") if (m := _HOST.search(u or "")) else "" for u in urls]
            labels = [h.split(".") for h in hosts]
            declared = [m[1].lower() if (m := _DECLARED.search(p or "")) else "" for p in pages]
            scores = [model.scores(visible(p or "")).tolist() for p in pages]
            columns = [hosts, [".".join(x[-2:]) for x in labels], [x[-1] for x in labels], declared]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, "string") for c in columns], pa.array(scores, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "scores"])

    return work


def _softmax(x: Column) -> Column:
    """Of an array; its variable is evaluated once."""
    top = F.transform(F.array(x), lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a))))[0]
    return F.transform(F.array(top), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def identify(pages: DataFrame, model: TextModel, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, lang, posterior, text_lang, declared, host): text_lang is what the text alone says, declared is empty where nothing is."""
    ship(pages.sparkSession)
    names, every = model.languages, range(len(model.languages))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    kind = rows.schema["page_id"].dataType.simpleString()
    seen = rows.mapInArrow(_read(model), f"page_id {kind}, host string, domain string, suffix string, declared string, scores array<double>")
    seen = stash(seen.withColumn("own", _softmax(F.col("scores"))), "seen")

    def sums(by: list[str], name: str, table: DataFrame = seen) -> DataFrame:
        each = table.groupBy(*by).agg(*[F.sum(F.col("own")[i]).alias(f"_{i}") for i in every])
        return each.select(*by, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in every]).alias(name))

    hosts = sums(["host", "domain", "suffix"], "of_host")
    domains = stash(sums(["domain"], "of_domain"), "domains")
    suffixes = stash(sums(["suffix"], "of_suffix"), "suffixes")
    hosts = stash(stash(hosts, "bare_hosts").join(domains, "domain").join(suffixes, "suffix").select("host", "of_host", "of_domain", "of_suffix"), "hosts")
    declared = stash(sums(["declared"], "of_declared"), "declared")
    total = seen.agg(*[F.sum(F.col("own")[i]) for i in every]).first()
    total = F.array(*[F.lit(float(x or 0)) for x in total])

    joined = seen.join(hosts, "host").join(declared, "declared")
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)

    def smoothed(counts: Column, towards: Column) -> Column:
        """Counts without the page's own, smoothed towards the level above."""
        less = F.zip_with(counts, F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
        return F.transform(F.array(F.struct(less.alias("c"), towards.alias("t"))), lambda x: F.zip_with(x["c"], x["t"], lambda c, t: (c + PRIOR * t) / (sum_of(x["c"]) + PRIOR)))[0]

    prior = F.array(*[F.lit(1.0 / len(names)) for _ in every])
    joined = joined.withColumn("p0", smoothed(total, prior))
    for above, level, counts in (("p0", "p1", "of_suffix"), ("p1", "p2", "of_domain"), ("p2", "p3", "of_host")):
        joined = joined.withColumn(level, smoothed(F.col(counts), F.col(above)))
    # the chance that a page of a language declares this: counted, and smoothed towards declaring its own
    codes = F.array(*[F.lit(x) for x in names])
    expected = F.transform(codes, lambda x: F.when(x == F.col("declared"), 0.8).when(F.col("declared") == "", 0.1).otherwise(0.1 / max(1, len(names) - 1)))
    spread = F.zip_with(F.col("of_declared"), F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
    per_language = F.zip_with(total, F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
    chance = F.zip_with(F.zip_with(spread, expected, lambda c, e: c + PRIOR * e), per_language, lambda c, n: c / (n + PRIOR))
    joined = joined.withColumn("declares", chance)
    score = F.zip_with(F.zip_with("scores", "p3", lambda s, p: s + F.log(F.greatest(p, F.lit(1e-300)))), "declares", lambda s, c: s + F.log(F.greatest(c, F.lit(1e-300))))
    joined = joined.withColumn("fused", _softmax(score))
    best = lambda a: F.element_at(codes, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.select("page_id", best(F.col("fused")).alias("lang"), F.array_max("fused").alias("posterior"), best(F.col("own")).alias("text_lang"), "declared", "host")
