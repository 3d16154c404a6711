import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillscan.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Classes by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) > 0 and 5 * len(a & b) >= 4 * len(a | b):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def test_classes_equal_those_of_all_pairs(spark, documents, docs_list, empty):
    found = near_dup.classes(documents).collect()
    want = brute([(d, t) for d, t, _ in docs_list])
    assert {r["doc_id"]: r["class_id"] for r in found} == want and len(found) == len(docs_list)
    assert sum(r["kept"] for r in found) == len(set(want.values()))  # one row of each class, also where an id repeats
    kept = near_dup.deduplicated(documents)
    assert kept.count() == len(set(want.values()))
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(want.values())
    assert near_dup.classes(empty).count() == 0


def test_chains_and_large_groups(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    seed = [random.choice(words) for _ in range(200)]
    rows = [(1000, " ".join(seed))]
    for i in range(60):  # one hot group: copies that differ in two places each
        t = list(seed)
        for _ in range(2):
            t[random.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    chain = [random.choice(words) for _ in range(120)]
    for i in range(12):  # each like the one before it, the ends unlike
        chain = chain[4:] + [f"c{i}{j}" for j in range(4)]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, " ".join(random.choice(words) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == brute(rows)


def test_copies_that_only_their_source_links(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 30)  # several blocks in a group
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for cluster in range(3):  # copies like their source and unlike each other, in groups beyond SMALL
        seed = [random.choice(words) for _ in range(200)]
        rows.append((1000 * cluster + 90, " ".join(seed)))
        for i in range(80):
            t = list(seed)
            for at in random.sample(range(10, 190), 3):
                t[at] = f"x{cluster}.{i}"
            rows.append((1000 * cluster + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len(set(want.values())) == 3
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == want


def test_near_copies_with_unequal_repeats(spark):
    rows = []
    for i in range(60):  # one text of a pair repeats a quarter of its words many times
        words = [f"w{i}.{j}" for j in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:25] * 1000 + words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) == 60
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == want


def test_repeated_rows_leave_one(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (1, words, "b"), (2, words, "c"), (3, "", None), (3, None, None), (None, "own text here", None), (None, "own text here", None), (4, "one more", "d"), (4, "and another", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    found = near_dup.classes(df)
    assert found.count() == len(rows) and found.where("kept").count() == 5
    left = near_dup.deduplicated(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "own text here"), (1, words), (3, ""), (4, "and another"), (4, "one more")]


def test_registers_that_agree(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (50, near_dup.REGISTERS)).astype("u1")
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 256, a.shape)).astype("u1")
    rows = [(x.view("<i8").tolist(), y.view("<i8").tolist(), int((x == y).sum())) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(near_dup.alike(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_parts_by_size_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 25)
    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", 40)
    random.seed(21)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 100 + i])) for i in range(0, 200)]  # sizes in a chain of links, ends unlike
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()} == brute(rows)


def test_filter_of_texts_keeps_what_is_wanted(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "unhex(md5(string(id))) AS h")
    wanted = rows.where("doc_id % 7 = 0").selectExpr("h AS of", "doc_id AS rep")
    found = {r[0] for r in near_dup._likely(rows, wanted).select("doc_id").collect()}
    assert found >= set(range(0, 3000, 7)) and len(found) < 500


def test_common_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, rng.integers(0, 300))).astype("u8") for _ in range(60)]
    doc, value = np.repeat(np.arange(60), [len(x) for x in sets]), np.concatenate(sets)
    rows, columns = np.arange(0, 60, 2), np.arange(60)
    for at_once in (7, 2048):
        found = near_dup.common_counts(doc, value, rows, columns, 60, at_once)
        assert found.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
    assert near_dup.common_counts(doc[:0], value[:0], rows, columns, 60).sum() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a = {int(x): float(w) for x, w in zip(rng.integers(1, 2**63, 80), rng.uniform(0.5, 4, 80))}
    b = {x: w * (1 + (i % 3)) for i, (x, w) in enumerate(a.items()) if i % 5}
    both = [x for x in a if x in b]
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in both)
    doc = np.repeat([0, 1], [len(a), len(b)])
    value, weight = np.array([*a, *b], "u8"), np.array([*a.values(), *b.values()])
    kept = near_dup.signatures(doc, value, weight, 2, registers=8192)
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.02
