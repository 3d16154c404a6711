"""Mixing sources to target weights, in DataFrame operations only.

1. Sizes in words by source; targets share out a multiple of all words by
   weight. A target stops at a multiple of its source's size, and the excess is
   shared again by weight until none is above (solved in one sorted pass).
2. Each source's words, its documents in a hashed order, are one stream that is
   cut into blocks of block_words words. Offsets are summed in two levels
   (hashed buckets of a source, then documents in a bucket), so a source that
   holds a third of all rows is dealt out like any other.
3. A source draws as many blocks as hold its target; the last is cut short, so
   that the words taken meet the target to the word.
4. Every slot of every output shard draws its source with the chance of the
   source's share of all draws: a shard's counts are multinomial. Running counts
   over the shards are then stretched so that each source ends at its own number
   of draws, which leaves the shards' deviations and takes the totals'. Draws
   [low, high) of a source fall on the shard.
5. Draw g of a source takes block perm(g mod n) in pass g div n; perm is a
   pseudorandom permutation of the source's n block numbers (a swap-or-not
   shuffle, exact for any n, and its own inverse in reverse). A block finds its
   draws by the inverse, so blocks and slots are joined by index without a table
   of all slots. As draws are at most cap times n, no document is taken more than
   cap times.

Null texts have no words and are never taken; a null source is a source of its
own, last in order; repeated rows are rows of their own; texts are never cut off,
however long; documents that tie in the hashed order follow their id, size and
text; an empty table gives no rows. Every choice follows from hashes of ids and
texts, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import SPACE, WORD, drop, stash, text_of

ROUNDS = 10
CELLS = 1 << 12  #: of the interval from 0 to 1 in which slots look up their source
CHUNK = 4096  #: draws by which a source's draws and the plan of the shards are joined


def _swapped(index: Column, n: Column, seed: Column, rounds: Sequence[int]) -> Column:
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), r, seed).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), index, swap)


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """The place of each of 0..n-1 in a pseudorandom permutation of these."""
    return _swapped(index, n, seed, range(1, ROUNDS + 1))


def unpermuted(place: Column, n: Column, seed: Column) -> Column:
    """The inverse of permuted()."""
    return _swapped(place, n, seed, range(ROUNDS, 0, -1))


def source_targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source of sized (source, size): source, sid (1 is first), source_size long, target double."""
    rows = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("sid", in_order).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "sid")
    capped = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("fill", (F.lit(float(share)) * F.sum("source_size").over(everything) - capped) / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the fill level holds from the first source on that it does not lift above its cap
    first = F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "sid", "fill"))).over(everything)["fill"]
    return rows.select("source", "sid", "source_size", F.coalesce(F.least("most", first * F.col("w")), F.col("most")).alias("target"))


def drawn(sources: DataFrame, block_words: int, seed: int = 11) -> DataFrame:
    """sources with n (its blocks), key (of its permutation), draws, and short: the words by which its last draw is cut."""
    b, size = F.lit(block_words).cast("long"), F.col("source_size")
    rows = sources.withColumns({"n": F.ceil(size / block_words).cast("long"), "key": F.xxhash64("sid", F.lit(seed)), "want": F.round("target").cast("long")})
    rows = rows.withColumns({"full": F.when(size > 0, F.floor(F.col("want") / F.when(size > 0, size))).otherwise(F.lit(0)).cast("long"), "tail": size - (F.col("n") - 1) * b})
    rows = rows.withColumn("rest", F.when(size > 0, F.col("want") - F.col("full") * size).otherwise(F.lit(0)))
    # the shorter last block is drawn at this place of the last pass
    rows = rows.withColumn("at", F.when(F.col("n") > 0, unpermuted(F.col("n") - 1, F.greatest("n", F.lit(1).cast("long")), F.col("key"))).otherwise(F.lit(0)))
    rest, before = F.col("rest"), F.col("at") * b
    part = F.when(rest <= before, F.ceil(rest / b)).otherwise(F.col("at") + 1 + F.ceil(F.greatest(F.lit(0), rest - before - F.col("tail")) / b)).cast("long")
    rows = rows.withColumn("part", part)
    held = F.col("part") * b - F.when(F.col("part") > F.col("at"), b - F.col("tail")).otherwise(F.lit(0))
    return rows.select("source", "sid", "source_size", "target", "n", "key", (F.col("full") * F.col("n") + F.col("part")).alias("draws"), F.when(F.col("part") > 0, held - rest).otherwise(F.lit(0)).alias("short"))


def shard_counts(sources: DataFrame, shard_slots: int, seed: int = 12) -> DataFrame:
    """(shard, sid, count): how often each source is drawn by the slots of each shard. sources: sid, draws. The draws of a shard are multinomial."""
    ends = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sources.where("draws > 0").select("sid", "draws", F.sum("draws").over(ends).alias("high"), F.sum("draws").over(every).alias("total"))
    total = rows.agg(F.max("total")).first()[0] or 0
    spark = sources.sparkSession
    # a slot's place in [0, total) lies in one source's part; both are looked up by cells
    cell = lambda at: F.floor(at * CELLS / total).cast("int")
    parts = rows.select("sid", (F.col("high") - F.col("draws")).alias("low"), "high")
    parts = parts.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell")) if total else parts.withColumn("cell", F.lit(0))
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("at"))
    slots = slots.withColumn("cell", cell(F.col("at")) if total else F.lit(0))
    drawn_by = slots.join(parts, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return drawn_by.groupBy("shard", "sid").agg(F.count("*").alias("count"))


def shard_plan(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, shard, low, high): draws [low, high) of a source fall on the shard. Together a source's intervals are [0, its draws)."""
    by = Window.partitionBy("sid")
    rows = counts.join(sources.select("sid", "draws"), "sid")
    rows = rows.withColumns({"upto": F.sum("count").over(by.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("count").over(by)})
    stretched = lambda x: F.floor(x * F.col("draws") / F.col("all")).cast("long")
    rows = rows.select("sid", "shard", stretched(F.col("upto") - F.col("count")).alias("low"), F.when(F.col("upto") == F.col("all"), F.col("draws")).otherwise(stretched(F.col("upto"))).alias("high"))
    # a source that no slot drew goes to the first shard
    unseen = sources.where("draws > 0").join(counts.select("sid").distinct(), "sid", "left_anti").select("sid", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("low"), F.col("draws").alias("high"))
    return rows.where("high > low").unionByName(unseen)


def _placed(docs: DataFrame, sources: DataFrame, n_docs: int, *ties: str) -> DataFrame:
    """docs (doc_id, source, size and more) with sid, source_size, target, n, key, draws, short, and at: a document's first word in its source's stream."""
    about = sources.withColumnRenamed("source", "_of")
    known = docs.join(about, docs["source"].eqNullSafe(F.col("_of"))).drop("_of")
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(1, n_docs // 256))))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("n_bucket"))
    before = F.coalesce(F.sum("n_bucket").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stash(sums.select("sid", "bucket", before.alias("base")), "bases")
    order = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", *ties)
    local = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = known.withColumn("local", local).join(bases, ["sid", "bucket"])
    return placed.withColumn("at", F.col("base") + F.col("local")).drop("base", "local", "bucket")


def _takes(block_words: int) -> Column:
    """array<struct<i, g, words, cut>> of a placed document: draw g takes so many words of its i-th piece. A piece is what lies in one block; cut: not all of it."""
    b, at, size = F.lit(block_words).cast("long"), F.col("at"), F.col("size")
    first = F.floor(at / b)
    blocks = F.when(size > 0, F.sequence(first, F.floor((at + size - 1) / b))).otherwise(F.array().cast("array<bigint>"))
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def of_block(block: Column) -> Column:
        start, end = F.greatest(at, block * b), F.least(at + size, block * b + b)
        whole = F.least(F.col("source_size"), block * b + b)

        def draws(j: Column) -> Column:
            passes = F.floor((F.col("draws") - 1 - j) / F.col("n"))
            gs = F.when(F.col("draws") > j, F.transform(F.sequence(F.lit(0).cast("long"), passes), lambda p: p * F.col("n") + j)).otherwise(F.array().cast("array<bigint>"))
            # the last draw of a source ends early
            upto = lambda g: F.when(g == F.col("draws") - 1, F.least(end, whole - F.col("short"))).otherwise(end)
            return F.transform(gs, lambda g: F.struct((block - first).cast("int").alias("i"), g.alias("g"), F.greatest(F.lit(0).cast("long"), upto(g) - start).alias("words"), (upto(g) < end).alias("cut")))

        return once(unpermuted(block, F.col("n"), F.col("key")), draws)

    return F.filter(F.flatten(F.transform(blocks, of_block)), lambda x: x["words"] > 0)


def _sourced(docs: DataFrame, block_words: int, shard_slots: int, **targets) -> tuple[DataFrame, DataFrame]:
    """Of docs (source, size): the sources, and the plan of the shards with its chunks."""
    sources = stash(drawn(source_targets(docs.select("source", "size"), **targets), block_words), "sources")  # a row for each source: its size decides how it is joined
    counts = stash(shard_counts(sources, shard_slots), "counts")
    plan = shard_plan(counts, sources)
    plan = plan.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor((F.col("high") - 1) / CHUNK))))
    plan = stash(plan, "plan")
    drop(counts)
    return sources, plan


def _on_shards(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (sid, g and more) with the shard of each draw, and slot, which orders a shard."""
    rows = rows.withColumn("chunk", F.floor(F.col("g") / CHUNK))
    rows = rows.join(plan, ["sid", "chunk"]).where((F.col("g") >= F.col("low")) & (F.col("g") < F.col("high")))
    return rows.withColumn("slot", F.xxhash64("sid", "g")).drop("chunk", "low", "high")


def _sizes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def taken(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = 256, shard_slots: int = 16384, **targets) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): how many words of each document the mix takes, repeats counted, and by shard.

    shards: array<struct<shard, words>>, in order of shards.
    """
    sized = stash(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), _sizes(text_of(text)).alias("size")), "sizes")
    sources, plan = _sourced(sized, block_words, shard_slots, **targets)
    placed = stash(_placed(sized.withColumn("rid", F.monotonically_increasing_id()), sources, sized.count()), "placed")
    drop(sized)
    each = placed.select("rid", "sid", F.explode(_takes(block_words)).alias("t")).select("rid", "sid", "t.g", "t.words")
    # a document has one row for each of its blocks, at most 2 for each 256 of its words
    by_shard = _on_shards(each, plan).groupBy("rid", "shard").agg(F.sum("words").alias("words"))
    got = by_shard.groupBy("rid").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    out = placed.join(got, "rid", "left")
    none = F.array().cast(got.schema["shards"].dataType)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = 256, shard_slots: int = 16384, **targets) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each piece of a document that a draw takes, with the white space between its words.

    Each partition holds whole shards, a shard's rows in the order of its slots. n_chars is counted again.
    """
    body, columns = text_of(text), list(docs.columns)
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), _sizes(body).alias("size"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    sized = stash(held.select("source", "size"), "sizes")
    sources, plan = _sourced(sized, block_words, shard_slots, **targets)
    n_docs = sized.count()
    drop(sized)
    at_text = columns.index(text)
    body = F.coalesce(F.col("row")[f"c{at_text}"].cast("string"), F.lit(""))
    placed = _placed(held.withColumn("tie", F.xxhash64(body)), sources, n_docs, "tie").where("size > 0")
    # the text's pieces: up to the end of its first block, then block by block, without the white space around each
    more = f"(?:{SPACE}+{WORD}+){{0,"  # possessive, so one pass without a way back
    lead = (F.lit(block_words - 1) - F.pmod(F.col("at"), F.lit(block_words))).cast("string")
    head = F.call_function("regexp_extract", body, F.concat(F.lit(f"^{SPACE[:-1]}*+{WORD}+{more}"), lead, F.lit("}+")), F.lit(0))
    once = lambda value, f: F.transform(F.array(value), f)[0]
    rest = lambda h: F.regexp_extract_all(F.substring(body, F.length(h) + 1, F.length(body)), F.lit(f"{WORD}+{more}{block_words - 1}}}+"), F.lit(0))
    pieces = once(head, lambda h: F.concat(F.array(F.regexp_replace(h, f"^{SPACE}", "")), rest(h)))
    takes = once(F.struct(_takes(block_words).alias("t"), pieces.alias("p")), lambda x: F.transform(x["t"], lambda t: F.struct(t["g"].alias("g"), t["i"].alias("i"), t["words"].alias("words"), t["cut"].alias("cut"), F.get(x["p"], t["i"]).alias("text"))))
    each = placed.select("sid", F.col("row").withField(f"c{at_text}", F.lit(None).cast("string")).alias("rest"), F.explode(takes).alias("t"))
    rows = _on_shards(each.select("sid", "rest", "t.*"), plan)
    # only a source's last draw holds fewer words than its piece
    part = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(f"^{WORD}+{more}"), (F.col("words") - 1).cast("string"), F.lit("}+")), F.lit(0))
    rows = rows.withColumn("text", F.when(F.col("cut"), part).otherwise(F.col("text")))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "slot", "sid", "g", "i")
    named = [F.col("text").alias(c) if i == at_text else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(columns)]
    return rows.select(*named)
