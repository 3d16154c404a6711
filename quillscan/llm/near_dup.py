"""Near-duplicate classes by ProbMinHash.

Texts are sets of five-word shingles. Each shingle is a Poisson process whose rate
is its weight; every arrival falls on one of K registers, and a register keeps the
shingle that comes first. Two texts agree in a register with their probability
Jaccard similarity. All weights are equal, however often a shingle repeats: then
this is the Jaccard similarity of the sets, by which links are decided. A text's arrivals are taken round by round, and a
shingle stops as soon as its next arrival is later than all registers' minima.

K = 96 registers make 24 bands of 4; at a similarity of 0.8 a pair shares none
of them with a chance of 3e-6. Texts that share a band's value are a group. Two
of a group are a link if the exact Jaccard similarity of their sets is 0.8 or
more; what differs too much in size (exact) or agrees in fewer than AGREE of the
96 registers (at 0.8 a chance of 1e-7) is not looked at.

First every text is compared with its groups' first, which mostly leaves one
class in a group. Where several are left, pairs in different classes are looked
at: in groups of up to SMALL in a join, in larger ones in cells. There a group is
dealt into parts by size and blocks, and cells (two blocks) keep the texts whose
registers fit one of another class; these are dealt again, and cells of about
BLOCK texts compare their shingles, exactly. A cell returns one row for each text
at most, so no group's pairs are ever written out.

Equal texts are one node from the start, by a 128-bit hash of the text. Classes
are the connected components of the links, found by smallest labels with
shortcuts in tables of the shared folder.

Null texts count as empty. Texts without words are similar only to equal ones;
texts of one to four words have their words as their one shingle. Texts are never
cut, however long. Repeated rows are copies, and one row of a class stays, also
where rows repeat an id. Ties (rows of the smallest id) go to the first row read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm import tok
from quillscan.llm.common import SPACE, drop, ship, stash, text_of

WORDS, THRESHOLD = 5, (4, 5)
REGISTERS, ROWS = 96, 4
AGREE = 54  #: registers in which the sides of a link agree, but for a chance of 1e-7
SMALL, SKETCH_BLOCK, BLOCK = 32, 8192, 1024
BITS, BITMAP = 1 << 26, 32768  #: of the filter of texts, and of one of its rows (a fixed value of Spark's bitmaps)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = None


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a limit."""

    def __missing__(self, word: str) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 300_000 and len(word) < 64:
            self[word] = out
        return out


_HASHES = WordHashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle's hash, count) of each distinct shingle, by text."""
    import re

    global _SPLIT
    _SPLIT = _SPLIT or re.compile(SPACE)
    words = [[w for w in _SPLIT.split(t) if w] for t in texts]
    sizes = np.array([len(w) for w in words], "i8")
    flat = np.array([_HASHES[w] for ws in words for w in ws], "u8")
    n = len(flat)
    whole = np.zeros(n, "u8")
    for i in range(WORDS):  # windows of the flat array; those that cross a text's end are not taken
        m = max(0, n - i)
        whole[:m] = mixed(whole[:m] * np.uint64(3) + flat[n - m :] + _MIX)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, 0)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    value = whole[at]
    few = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(few):
        import xxhash

        doc = np.append(doc, few)
        value = np.append(value, np.array([xxhash.xxh3_64_intdigest("\n".join(words[i]).encode("utf-8", "surrogatepass")) for i in few], "u8"))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) uint64: the shingle that each register keeps; 0 in texts without any."""
    when, kept = np.full(n * registers, np.inf), np.zeros(n * registers, "u8")
    has = np.zeros(n, bool)
    has[doc] = True
    when.reshape(n, registers)[~has] = 0
    clock, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        r = mixed(value + np.uint64(turn * int(_MIX) & (1 << 64) - 1))
        clock = clock - np.log1p(-(r >> np.uint64(11)).astype("f8") * 2.0**-53) / weight
        spot = doc * registers + (mixed(r ^ _MIX) % np.uint64(registers)).astype("i8")
        early = clock < when[spot]
        spot, t, v = spot[early], clock[early], value[early]
        np.minimum.at(when, spot, t)
        won = t == when[spot]
        kept[spot[won]] = v[won]
        alive = clock < when.reshape(n, registers).max(1)[doc]
        doc, value, weight, clock = doc[alive], value[alive], weight[alive], clock[alive]
    return kept.reshape(n, registers)


def bands(kept: np.ndarray) -> np.ndarray:
    """(n, bands) int64: a hash of each band's registers."""
    parts = kept.reshape(len(kept), -1, ROWS)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype="u8") * _MIX, parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mixed(out * np.uint64(5) + parts[:, :, i])
    return out.view("i8")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, doc_id, h, text) to (at, doc_id, h, size, bands, sketch); a text's copies in a batch are computed once."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for a, b in tok.portions(texts, 4_000_000):
            number: dict[str, int] = {}
            which = np.array([number.setdefault(x, len(number)) for x in texts[a:b]], "i8")
            doc, value, _ = shingles(list(number))
            kept = signatures(doc, value, np.ones(len(doc)), len(number))
            size = np.bincount(doc, minlength=len(number))
            lists = lambda made, some: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(some[which], made.shape[1], 0)))).astype("i4")), pa.array(made[which][some[which]].ravel()))
            sketch = np.ascontiguousarray((kept & np.uint64(0xFF)).astype("u1")).view("<i8")
            columns = [*[batch.column(c).slice(a, b - a) for c in range(3)], pa.array(size[which], "int32"), lists(bands(kept), size > 0), lists(sketch, size >= 0)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "doc_id", "h", "size", "bands", "sketch"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b, link)."""
    up, down = THRESHOLD
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        size = [len(x) + len(y) for x, y in zip(left, right)]
        at = 0
        while at < len(size):
            end, held = at + 1, size[at]
            while end < len(size) and held + size[end] < 4_000_000:
                held += size[end]
                end += 1
            number: dict[str, int] = {}
            x = [number.setdefault(t, len(number)) for t in left[at:end]]
            y = [number.setdefault(t, len(number)) for t in right[at:end]]
            doc, value, _ = shingles(list(number))
            cut = np.searchsorted(doc, np.arange(len(number) + 1))
            sets = [value[i:j] for i, j in zip(cut[:-1], cut[1:])]
            link = []
            for i, j in zip(x, y):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                link.append(bool(both) and down * both >= up * (len(sets[i]) + len(sets[j]) - both))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, end - at) for c in range(2)], pa.array(link)], ["a", "b", "link"])
            at = end


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs (a, b) that are links."""
    body = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"t{name}"))
    both = pairs.join(body("b"), "b").join(body("a"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verified, "a long, b long, link boolean").where("link").select("a", "b")


def alike(a: Column, b: Column) -> Column:
    """How many of the registers of two sketches agree (8 bits of each, 8 to a long): the zero bytes of a XOR b."""

    def others(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return F.lit(REGISTERS) - reduce(lambda x, y: x + y, [others(i) for i in range(REGISTERS // 8)])


def _fits(a: str, b: str) -> Column:
    """Whether two sides may be similar: by their sizes (exact), then by their registers."""
    up, down = THRESHOLD
    small, large = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")
    return (small * down >= large * up) & (alike(F.col(f"s{a}"), F.col(f"s{b}")) >= AGREE)


def _sketches(held: pa.Table) -> np.ndarray:
    """(rows, registers) of bytes."""
    whole = held["sketch"].combine_chunks()
    return np.ascontiguousarray(np.asarray(whole.flatten(), "<i8").reshape(len(whole), -1)).view("u1")


def _promising(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    """The rows of a cell (two blocks) whose registers agree in AGREE with those of a text of another class there."""
    block, label = np.asarray(held["block"]), np.asarray(held["label"])
    rows, columns = (np.flatnonzero(block == k.as_py()) for k in key[2:])
    sketch = _sketches(held)
    across = np.ascontiguousarray(sketch[columns].T)
    stay = np.zeros(len(label), bool)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        same = np.zeros((len(part), len(columns)), "u1")
        for r in range(sketch.shape[1]):
            same += sketch[part, r][:, None] == across[r]
        near = (same >= AGREE) & (label[part][:, None] != label[columns])
        stay[part] |= near.any(1)
        stay[columns] |= near.any(0)
    return held.select(["key", "part", "node", "label"]).filter(pa.array(stay))


def common_counts(doc: np.ndarray, value: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int, at_once: int = 2048) -> np.ndarray:
    """(rows, columns): how many values two documents share. doc, value: distinct pairs, by document."""
    _, first, which, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    place = np.empty(len(first), "i8")
    place[np.argsort(first, kind="stable")] = np.arange(len(first))  # values that start in one document lie together
    shared = count[which] > 1
    doc, spot = doc[shared], place[which[shared]]
    order = np.argsort(spot, kind="stable")
    doc, spot = doc[order], spot[order]
    _, spot = np.unique(spot, return_inverse=True)
    both = np.zeros((len(rows), len(columns)), "i4")
    of_row, of_column = np.full(n, -1), np.full(n, -1)
    of_row[rows], of_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    for low in range(0, int(spot[-1]) + 1 if len(spot) else 0, at_once):
        a, b = np.searchsorted(spot, (low, low + at_once))
        sides = []
        for where in (of_row, of_column):
            at = where[doc[a:b]]
            there, number = np.unique(at[at >= 0], return_inverse=True)
            dense = np.zeros((len(there), at_once), "f4")
            dense[number, spot[a:b][at >= 0] - low] = 1
            sides.append((there, dense))
        (r, x), (c, y) = sides
        both[np.ix_(r, c)] += (x @ y.T).astype("i4")
    return both


def _joined(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    """(a, b): nodes of a cell that a chain of links between its classes connects, each with the first of its chain."""
    block, node, label = (np.asarray(held[c]) for c in ("block", "node", "label"))
    rows, columns = (np.flatnonzero(block == k.as_py()) for k in key[2:])
    texts, found = held["text"].to_pylist(), []
    for a, b in tok.portions(texts, 4_000_000):
        doc, value, _ = shingles(texts[a:b])
        found.append((doc + a, value))
    doc, value = (np.concatenate(x) for x in zip(*found))
    size, (up, down) = np.bincount(doc, minlength=len(node)), THRESHOLD
    both = common_counts(doc, value, rows, columns, len(node))
    link = (both > 0) & (down * both >= up * (size[rows][:, None] + size[columns] - both)) & (label[rows][:, None] != label[columns])
    x, y = np.nonzero(link)
    x, y, low = rows[x], columns[y], np.arange(len(node))
    while (low[x] != low[y]).any():
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
    moved = np.flatnonzero(low != np.arange(len(node)))
    return pa.table({"a": node[low[moved]], "b": node[moved]})


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Deal the rows of every (key, part) into blocks of about so many, and copy each row to the cells (i, j) of its block with every other."""
    count = stash(rows.groupBy("key", "part").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    rows = rows.join(count, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _across(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), to be joined: from all pairs in different classes of the groups of members (key, node, label).

    Texts whose sizes differ by more than a quarter are never similar. A group is
    therefore dealt into parts by the logarithm of the size: part p holds the
    sizes of classes p and p - 1, and what is similar meets in a part.
    """
    up, down = THRESHOLD
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(down / up)).cast("long")
    held = members.join(nodes.select("node", "size", "sketch"), "node").withColumn("part", F.explode(F.array(step, step + 1)))
    dealt = _cells(held.drop("size"), SKETCH_BLOCK)
    near = dealt.groupBy("key", "part", "i", "j").applyInArrow(_promising, "key long, part long, node long, label long")
    near = stash(near.distinct(), "promising")
    dealt = _cells(near, BLOCK).join(texts, "node")
    return dealt.groupBy("key", "part", "i", "j").applyInArrow(_joined, "a long, b long").distinct()


def settled(nodes: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of the classes with links.

    nodes: (node, size, sketch); members: (key, node, n, first), the groups with a common band; texts: (node, text).
    """
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    stars = members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = stash(stars.join(side("a"), "a").join(side("b"), "b").where(_fits("a", "b")).select("a", "b"), "near")
    links = stash(_checked(near, texts), "links")
    drop(near)
    labels = components(links)
    named = stash(members.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    several = stash(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "several")
    if several.isEmpty():
        return labels
    rest = named.join(several, "key", "left_semi")
    # groups with a bounded number of members: their pairs in different classes
    few = stash(rest.where(F.col("n") <= SMALL).select("key", "node", "label").join(nodes, "node"), "few")
    of = lambda name: few.select("key", F.col("node").alias(name), F.col("label").alias(f"l{name}"), F.col("size").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    pairs = of("a").join(of("b"), "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _fits("a", "b"))
    pairs = stash(pairs.select("a", "b").distinct(), "pairs")
    more = stash(_checked(pairs, texts), "more")
    drop(few, pairs)
    across = stash(_across(rest.where(F.col("n") > SMALL).select("key", "node", "label"), nodes, texts), "across")
    drop(named, several)
    found = more.unionByName(across)
    return labels if found.isEmpty() else components(links.unionByName(found))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for nodes that have an edge."""
    edges = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = stash(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels0")
    for turn in range(1, 200):
        across = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        lower = stash(across.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), f"lower{turn}")
        # the label's own label: halves the way to the smallest
        short = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.least("label", "next").alias("label"))
        short = stash(short, f"labels{turn}")
        done = short.join(labels.withColumnRenamed("label", "was"), "node").where("label < was").isEmpty()
        drop(lower, labels)
        if done:
            drop(edges)
            return short
        labels = short
    raise RuntimeError("the labels did not settle")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose h is in wanted, and a share of the others: count of wanted / BITS.

    What is broadcast is a bitmap of BITS bits at most, whatever the input's
    size. It keeps texts without candidates out of the shuffle; where it is full
    it only loses its effect.
    """
    spot = F.pmod(F.xxhash64("h"), F.lit(BITS)).cast("long")
    marks = wanted.select(F.pmod(F.xxhash64("of"), F.lit(BITS)).cast("long").alias("spot")).select(F.floor(F.col("spot") / BITMAP).alias("bucket"), (F.col("spot") % BITMAP).alias("bit"))
    maps = stash(marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap")
    found = rows.withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") / BITMAP)).join(F.broadcast(maps), "bucket")
    bit = (F.col("spot") % BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1).select(*rows.columns)


def _digest(body: Column) -> Column:
    return F.unhex(F.md5(body))


def classified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stashed table: (doc_id, h, class_id, class_size, kept), h the hash of the text."""
    ship(docs.sparkSession)
    body = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _digest(body).alias("h"), body.alias("text"))
    signed = rows.withColumn("at", F.monotonically_increasing_id()).select("at", "doc_id", "h", "text")
    signed = stash(signed.mapInArrow(_signed, "at long, doc_id long, h binary, size int, bands array<long>, sketch array<long>"), "signed")
    one = signed.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("rep"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "bands", "sketch")])
    nodes = stash(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    groups = stash(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "groups")
    members = stash(keys.join(groups, "key"), "members")
    drop(groups)
    # one text for each node that could have a partner
    paired = stash(members.select("node").distinct(), "paired")
    wanted = stash(nodes.select("node", F.col("h").alias("of"), F.col("rep.doc_id").alias("rep")).join(paired, "node", "left_semi"), "wanted")
    held = _likely(rows, wanted).join(wanted, (F.col("h") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    texts = stash(held.dropDuplicates(["node"]), "texts")
    drop(paired, wanted)
    found = settled(nodes.select("node", "size", "sketch"), members, texts)
    drop(members, texts)
    known = nodes.select("node", "h", "rep", "copies").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = stash(known, "known")
    sizes = stash(known.groupBy("label").agg(F.min("rep").alias("best"), F.sum("copies").alias("class_size")), "classes")
    member = stash(known.join(sizes, "label").select("h", "best", "class_size"), "member")
    drop(nodes, known, sizes, found)
    out = signed.select("doc_id", "at", "h").join(member, "h")
    out = stash(out.select("doc_id", "h", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("at") == F.col("best.at")).alias("kept")), "classified")
    drop(signed, member)
    return out


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, kept): class_id is the smallest doc_id of a document's class, kept holds for one row of it."""
    return classified(docs, doc_id=doc_id, text=text).drop("h")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, one with the smallest id; of rows that repeat its id and text any one."""
    found = classified(docs, doc_id=doc_id, text=text)
    stay = found.groupBy(F.col("doc_id").alias("_stay_id"), F.col("h").alias("_stay_h")).agg(F.max("kept").alias("kept"), F.count("*").alias("_stay_n")).where("kept").drop("kept")
    stay = stash(stay, "stay")
    drop(found)
    key, digest = docs[doc_id].cast("long"), _digest(F.coalesce(docs[text].cast("string"), F.lit("")))
    of = lambda rows: docs.join(rows, key.eqNullSafe(F.col("_stay_id")) & (digest == F.col("_stay_h")), "left_semi")
    repeated = stay.where("_stay_n > 1")
    if repeated.isEmpty():
        return of(stay)
    # few rows repeat an id and a text; of these one stays
    first = of(repeated).groupBy(key, digest).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return of(stay.where("_stay_n = 1")).unionByName(first.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
