import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillscan.llm import mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(documents, docs_list, empty):
    sizes = Counter()
    for _, text, source in docs_list:
        sizes[source] += len(WORD.findall(text))
    want, got = water(sizes), mixing.taken(documents).collect()
    assert len(got) == len(docs_list)
    texts, taken = {d: (t, s) for d, t, s in docs_list}, Counter()
    for r in got:
        text, source = texts[r["doc_id"]]
        assert r["size"] == len(WORD.findall(text)) and r["source_size"] == sizes[source]
        assert abs(r["target"] - want[source]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1  # the last draw is cut to the word
    for r in got:
        assert sum(x["words"] for x in r["shards"]) == r["taken"]
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.taken(documents.repartition(5)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.taken(empty).count() == 0


def test_mixed_texts_are_the_words_taken(documents):
    docs = documents.where("doc_id != 900005")
    for block_words, shard_slots in ((256, 16384), (16, 50)):
        sizes = {"block_words": block_words, "shard_slots": shard_slots}
        want = {r["doc_id"]: r["taken"] for r in mixing.taken(docs, **sizes).collect()}
        rows = mixing.mix(docs, **sizes)
        assert rows.columns == documents.columns
        texts, got = {r["doc_id"]: " ".join(WORD.findall(r["text"] or "")) for r in docs.collect()}, Counter()
        for r in rows.collect():
            words = WORD.findall(r["text"])
            assert r["n_chars"] == len(r["text"]) and 0 < len(words) <= block_words and " ".join(words) in texts[r["doc_id"]]
            got[r["doc_id"]] += len(words)
        assert got == Counter({k: v for k, v in want.items() if v})


def plain_permutation(spark, n, key):
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key).cast("long")).alias("p")).collect()
    return {r["id"]: r["p"] for r in rows}


def test_slots_map_to_blocks_like_a_plain_loop(spark):
    rows = [(i, "ab"[i % 3 == 0], 7 + i % 11) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sources, plan = mixing._sourced(docs, 10, 4)
    placed = mixing._placed(docs, sources, 60).withColumn("t", F.explode(mixing._takes(10)))
    got = defaultdict(int)
    for r in placed.select("sid", F.floor((F.col("at") + 10 * F.col("t.i") - F.pmod("at", F.lit(10))) / 10).alias("block"), "t.g", "t.words").collect():
        got[r["sid"], r["g"], r["block"]] += r["words"]
    want = {}
    for s in sources.collect():
        perm = plain_permutation(spark, s["n"], s["key"])
        for g in range(s["draws"]):
            block = perm[g % s["n"]]
            words = min(10, s["source_size"] - 10 * block) - (s["short"] if g == s["draws"] - 1 else 0)
            want[s["sid"], g, block] = words
        assert sum(w for (sid, _, _), w in want.items() if sid == s["sid"]) == round(s["target"])
    assert got == want
    # every draw falls on one shard
    spans = defaultdict(list)
    for r in plan.select("sid", "shard", "low", "high").distinct().collect():
        spans[r["sid"]].append((r["low"], r["high"]))
    for s in sources.collect():
        ends = sorted(spans[s["sid"]])
        assert ends[0][0] == 0 and ends[-1][1] == s["draws"] and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_shard_counts_are_multinomial(spark):
    sources = spark.createDataFrame([(1, 30000), (2, 10000), (3, 20000), (4, 0)], "sid int, draws long")
    counts = mixing.shard_counts(sources, 600)
    got = {(r["shard"], r["sid"]): r["count"] for r in counts.collect()}
    shares, chi = {1: 1 / 2, 2: 1 / 6, 3: 1 / 3}, 0.0
    for shard in range(100):
        assert sum(got.get((shard, sid), 0) for sid in shares) == 600
        chi += sum((got.get((shard, sid), 0) - 600 * p) ** 2 / (600 * p) for sid, p in shares.items())
    assert 140 < chi < 265  # 200 degrees of freedom
    assert not any(sid == 4 for _, sid in got)
    plan = mixing.shard_plan(counts, sources.withColumn("source", F.col("sid")))
    sums = Counter()
    for r in plan.collect():
        sums[r["sid"]] += r["high"] - r["low"]
        assert abs(r["high"] - r["low"] - got[r["shard"], r["sid"]]) <= 0.05 * got[r["shard"], r["sid"]] + 1
    assert sums == {1: 30000, 2: 10000, 3: 20000}


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        p = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))
        got = spark.range(n).select("id", p.alias("p"), mixing.unpermuted(p, F.lit(n).cast("long"), F.lit(9)).alias("q")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and (n < 100 or [r["p"] for r in got] != list(range(n)))
        assert all(r["q"] == r["id"] for r in got)


def base_spans(text):
    kinds = [("assign", secrets.ASSIGN.replace("(?i)", ""), 2, 6, re.I), ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0)]
    found = [(m.start(), i, m.end(), k) for i, (k, p, g, n, flags) in enumerate(kinds) for m in re.finditer(p, text, flags) if len(m.group(g)) >= n]
    return sorted(found)


def test_secret_spans(documents, docs_list, empty):
    want = defaultdict(list)
    for d, text, _ in docs_list:
        want[d].append(base_spans(text))
    got = secrets.digest(secrets.scan(documents, keep=["doc_id"])).collect()
    assert len(got) == len(docs_list)
    for r in got:
        spans = want[r["doc_id"]][0]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        as_text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(as_text.encode()).hexdigest()
        assert set(filter(None, as_text.split(","))) <= set(r["spans"].split(","))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[900008]["n_assign"] == 1 and by_id[900009]["spans"].startswith("assign:0:") and by_id[900007]["n_access"] == 1
    assert "random:3:38" in by_id[900010]["spans"] and by_id[900010]["n_random"] == 1
    assert sum(r["n_random"] for r in got) <= 2  # clean texts have none
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(documents).collect()}
    assert clean[900009] == "[REDACTED]" and clean[900007] == "é token = 'abc' [REDACTED]\" [REDACTED] x [REDACTED] fin" and clean[900001] is None
    assert secrets.redacted(documents).columns == documents.columns
    assert secrets.scan(empty).count() == 0


def test_uniform_tokens_have_uniform_p_values(spark):
    import random

    random.seed(4)
    for kind, alphabet in secrets.ALPHABETS.items():
        rows = [("".join(random.choice(alphabet) for _ in range(40)), kind) for _ in range(400)]
        p = [r["p"] for r in secrets.with_p_values(spark.createDataFrame(rows, "t string, k string"), "t", "k").collect()]
        assert sum(x < 0.05 for x in p) < 48 and sum(x < 0.5 for x in p) > 120
    odd = spark.createDataFrame([("abababababab1212121212121212", "base36"), ("2024-01-02-report-final-v2-draft", "base36")], "t string, k string")
    assert all(r["p"] < 1e-2 for r in secrets.with_p_values(odd, "t", "k").collect())


def test_statistics_equal_plain_ones(spark):
    import math
    import random

    random.seed(9)
    rows = [("".join(random.choice(a) for _ in range(n)), k) for k, a in secrets.ALPHABETS.items() for n in (20, 33, 64, 65, 200)]
    for r in secrets.with_p_values(spark.createDataFrame(rows, "t string, k string"), "t", "k").withColumn("s", secrets.statistics(F.col("t"), F.col("k"))).collect():
        a, n = secrets.ALPHABETS[r["k"]], len(r["t"])
        codes = [a.index(c) - (len(a) - 1) / 2 for c in r["t"]]
        squares = sum(v * v for v in Counter(r["t"]).values())
        runs = 1 + sum((x > 0) != (y > 0) for x, y in zip(codes, codes[1:]))
        serial = sum(x * y for x, y in zip(codes, codes[1:]))
        assert (r["s"]["symbols"], r["s"]["squares"], r["s"]["runs"]) == (n, squares, runs) and abs(r["s"]["serial"] - serial) < 1e-6
        normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
        assert abs(r["p_runs"] - normal((runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4))) < 1e-3
        assert abs(r["p_serial"] - normal(serial / ((len(a) ** 2 - 1) / 12 * math.sqrt(n - 1)))) < 1e-3
        half = -sum(math.log(r[c]) for c in ("p_chi", "p_runs", "p_serial"))
        assert abs(r["p"] - math.exp(-half) * (1 + half + half * half / 2)) < 1e-9


def test_exact_tails_of_chi_squared():
    from itertools import product

    tails = secrets.square_tails(3, 6, 40)
    for n in (1, 4, 6):
        sums = [sum(v * v for v in Counter(x).values()) for x in product("abc", repeat=n)]
        for s in range(41):
            assert abs(tails[n, s] - sum(v >= s for v in sums) / len(sums)) < 1e-12


def plain_limits(bins, q):
    """The procedure over {(encoding, scale): [bin, ...]} in plain loops."""
    import math

    first = math.ceil((math.log10(secrets.RANDOM_FROM) + secrets.DECADES) * secrets.STEPS)
    edge = lambda b: 10 ** (b / secrets.STEPS - secrets.DECADES)
    out = {}
    for (name, scale), own in bins.items():
        pool = [b for (n, _), x in bins.items() if n == name for b in x]
        weight = Counter()
        for b in pool:
            weight[b] += secrets.PRIOR / len(pool)
        for b in own:
            weight[b] += 1
        random = sum(w for b, w in weight.items() if b >= first) / (1 - edge(first))
        for b, last in zip(sorted(weight), [None, *sorted(weight)]):
            low = 0.0 if last is None else edge(last + 1)
            above = sum(w for x, w in weight.items() if x >= b)
            if max(0.0, above - random * (1 - low)) <= q * above:
                out[name, scale] = b
                break
    return out


def test_reported_limits_equal_plain_ones(spark):
    import random

    random.seed(12)
    bins = {("hex", 5): [random.choice([100, 200, 399, 396, 390, 380]) for _ in range(40)], ("hex", 6): [150] * 50 + [399, 395], ("base64", 5): [398], ("base36", 4): [20, 30]}
    rows = [(n, s, b) for (n, s), x in bins.items() for b in x]
    got = {(r["encoding"], r["scale"]): r["limit"] for r in secrets.report_limits(spark.createDataFrame(rows, "encoding string, scale int, bin int")).collect()}
    assert got == plain_limits(bins, 0.05) and ("base36", 4) not in got and got["hex", 6] > 150


def test_false_discoveries_of_reported_spans(spark):
    import random

    random.seed(14)
    token = lambda n: "".join(random.choice(secrets.ALPHABETS["base64"]) for _ in range(n)).replace("/", "a").replace("+", "b")
    path = lambda i: f"Archive/2024/{i % 12 + 1:02d}/{i % 28 + 1:02d}/Report{i:06d}final"
    rows = [(i, "k7Q" + token(37)) for i in range(300)] + [(1000 + i, path(i)) for i in range(900)]
    found = {r["id"] for r in secrets.scan(spark.createDataFrame(rows, "id long, text string"), keep=["id"]).where("size(spans) > 0").collect()}
    false = sum(i >= 1000 for i in found)
    assert len(found) - false >= 0.9 * 300 and false <= 0.1 * len(found)


def test_structured_tokens_do_not_hide_random_ones(spark):
    import random

    random.seed(6)
    token = lambda: "q7" + "".join(random.choice(secrets.ALPHABETS["base36"]) for _ in range(27))
    rows = [(i, token()) for i in range(400)] + [(1000 + i, f"user{i:06d}session{i:06d}abcdef") for i in range(3600)]
    found = {r["id"] for r in secrets.scan(spark.createDataFrame(rows, "id long, text string"), keep=["id"]).where("size(spans) > 0").collect()}
    assert len(found & set(range(400))) >= 0.97 * 400
    assert len(found - set(range(400))) <= 0.07 * len(found)


def test_every_mix_of_digits_and_letters_is_tested(spark):
    tokens = ["key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "Q8ZX7LM2VT9RK1WP3YB60NC5HD4JF", "A1B2C-3D4E5-F6G7H-8J9K0-L1M2N", "F47AC10B-58CC-4372-A567-0E02B2C3D479", "q8zx/7lm2+vt9rk1wp_3yb60nc5hd4jf"]
    rows = [(i, f"see {t} there") for i, t in enumerate(tokens)] + [(100, "2024/01/02/12345678901234567890/x")]
    got = {r["id"]: r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "id long, text string"), keep=["id"])).collect()}
    assert got == {i: f"random:4:{4 + len(t)}" for i, t in enumerate(tokens)} | {100: ""}


def figures(text):
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_figures(documents, docs_list, empty):
    want = {d: figures(t) for d, t, _ in docs_list}
    got = quality.judge(documents, keep=["doc_id"]).collect()
    assert len(got) == len(docs_list)
    for r in got:
        n, chars, symbols, dup, repeat = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
    stay = sorted(r["doc_id"] for r in quality.kept(documents).collect())
    assert stay == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality.judge(empty).count() == 0


def test_cascade_order_is_by_conditional_rejections_per_cost(documents):
    # rule 1 rejects most for its cost; what it leaves makes rule 2 worth more than rule 0, whose figure is known by then
    rules = (("a", ("x",), None), ("b", ("x", "y"), None), ("c", ("z",), None))
    order = quality.in_order({"x": 1.0, "y": 1.0, "z": 4.0}, {"110": 50, "010": 40, "001": 20, "000": 90}, rules)
    assert [(n, round(s, 3)) for n, s, _ in order] == [("a", 0.25), ("b", round(40 / 150, 3)), ("c", round(20 / 110, 3))]
    assert [round(c, 2) for *_, c in order] == [1.0, 1.0, 4.0]
    found = quality.ordered(documents, sample_rows=100)
    assert {n for n, *_ in found} == {n for n, *_ in quality.RULES} and all(0 <= s <= 1 and c > 0 for _, s, c in found)


def test_verdicts_do_not_depend_on_the_order(documents):
    names = [n for n, *_ in quality.RULES]
    t = F.coalesce("text", F.lit(""))
    rows = documents.select(*[quality.rejects(t, order).isNull().alias(f"k{i}") for i, order in enumerate((names, names[::-1], names[3:] + names[:3]))])
    assert rows.where("k0 != k1 OR k0 != k2").count() == 0 and 0 < rows.where("k0").count() < rows.count()


def test_columns_of_the_operators_own_names(documents):
    odd = documents.withColumns({c: F.lit(1) for c in ("spans", "h", "body", "clean", "hits", "p", "sid", "at", "w", "kept", "rid")})
    assert secrets.redacted(odd).columns == odd.columns and mixing.mix(odd.limit(20)).columns == odd.columns
    assert quality.judge(odd, keep=["doc_id", "t", "w"]).columns[:3] == ["doc_id", "t", "w"] and quality.kept(odd).columns == odd.columns
    assert secrets.scan(odd, keep=["spans", "h"]).columns == ["spans", "h", "spans"]
