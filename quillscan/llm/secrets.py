"""Secret scanning with a battery of randomness tests, in DataFrame operations only.

Three patterns give the base spans: assignments to names such as password,
access keys, and long hexadecimal runs. Beside these, every run of at least
MIN_TOKEN key characters that overlaps no base span and mixes digits with
letters is a candidate. Its encoding is inferred (hex, base32, base36, base64);
separators (- _ + /) are symbols of base64 only, which is for tokens that mix
upper with lower case, and are left out of the tests of all others. Under the
hypothesis that its symbols are independent and uniform over that alphabet three
tests are taken: chi-squared for uniformity (an exact table up to EXACT symbols),
the number of runs above and below the middle of the alphabet, and serial
correlation at lag one. Fisher's method joins the three to one p-value.

Random tokens have uniform p-values, structured text (identifiers, paths, dates)
small ones. What is reported is controlled: within strata of encoding and length
(powers of two) a histogram of all candidates' p-values is taken; the part above
RANDOM_FROM tells how many candidates are random, and what is left of the
histogram when their uniform share is taken off is the tail of the structured
ones. Tokens are reported from the smallest p-value on at which the structured
ones among them are at most a share q (Benjamini and Hochberg's rule with p-values
under the fitted structured hypothesis). A stratum's histogram counts PRIOR more
candidates that are spread like all of its encoding, which steadies small strata.
Random tokens below the limit are lost: less than RANDOM_FROM of them, unless
structured ones are found above it. Structured ones above RANDOM_FROM count as
random: of few symbols the tests tell little. The histogram is small, so the
candidates are never in one place.

A text's spans follow from the text, so copies are scanned once. Null texts count
as empty; repeated rows have the same spans each; empty texts have none; texts are
scanned whole, however long; an empty table gives no rows. Spans that tie in their
start are in order of their kind. Offsets count code points, ends excluded.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.llm.common import drop, stash, text_of

#: Kinds in order, pattern, group whose length counts (0: the match), least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
MIN_TOKEN = 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN
#: What a text must hold for a pattern to be tried on it. A run of hexadecimal digits that is long enough matches whole, so its guard can serve as the pattern.
GUARDS = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "random": RUN}
SEPARATORS = "_+/-"
ORDER = ("assign", "access", "hex", "random")
#: Bins of p-values: so many to a power of ten, down to 10 ** -DECADES.
STEPS, DECADES = 20, 20
#: p-values from here on count as those of random tokens; candidates that each stratum is given from all of its encoding; symbols up to which chi-squared is exact, and the largest sum of squares in its table.
RANDOM_FROM, PRIOR, EXACT, SQUARES = 0.05, 8.0, 64, 512
#: Encodings, their alphabets.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _hits(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """A struct for each match, in order: kind, i, gap (code points since the last match), n, whether it is long enough, and its text if it is a candidate."""
    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,ok:boolean,token:string>>")
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def hit(x: Column, i: Column) -> Column:
        token = x["0"] if kind == "random" else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["2"]).alias("gap"), F.length(x["0"]).alias("n"), (F.length(x["1"]) >= least).alias("ok"), token.alias("token"))

    zipped = F.arrays_zip(matches.alias("0"), sizes.alias("1"), gaps.alias("2"))
    return F.when(text.rlike(GUARDS[kind]), F.transform(F.filter(zipped, lambda x: x["0"].isNotNull()), hit)).otherwise(nothing)


def encoding(token: Column) -> Column:
    """The smallest alphabet that a token mixing digits and letters fits, separators aside; null for other tokens."""
    digit, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    return (
        F.when(~digit | ~(lower | upper), None)
        .when(lower & upper, "base64")
        .when(token.rlike(f"^(?:[0-9a-f{SEPARATORS}]+|[0-9A-F{SEPARATORS}]+)$"), "hex")
        .when(token.rlike(f"^[A-Z2-7{SEPARATORS}]+$"), "base32")
        .otherwise("base36")
    )


def square_tails(k: int, most: int = EXACT, cap: int = SQUARES) -> np.ndarray:
    """[n, s]: the chance that the squared counts of n uniform symbols of k add up to s or more, for n up to most and s up to cap.

    Built letter by letter from exponential generating functions.
    """
    ways = np.zeros((most + 1, cap + 2))  # the last column is for what is beyond cap
    ways[0, 0] = 1.0
    times = [j for j in range(most + 1) if j * j <= cap]
    for _ in range(k):
        new = np.zeros_like(ways)
        for j in times:
            rows = ways[: most + 1 - j] / math.factorial(j)
            new[j:, j * j : cap + 1] += rows[:, : cap + 1 - j * j]
        ways = new
    chance = ways * np.array([math.factorial(n) / float(k) ** n for n in range(most + 1)])[:, None]
    chance[:, cap + 1] = np.maximum(0.0, 1.0 - chance[:, : cap + 1].sum(1))
    return np.clip(chance[:, ::-1].cumsum(1)[:, ::-1][:, : cap + 1], 0.0, 1.0)


def chi_table(spark: SparkSession) -> DataFrame:
    """(encoding, symbols, squares, tail): the exact tails that are neither 0 nor 1. Its size is fixed: some 20,000 rows."""
    rows = []
    for name, alphabet in ALPHABETS.items():
        tails = square_tails(len(alphabet))
        for n in range(2, EXACT + 1):
            rows += [{"encoding": name, "symbols": n, "squares": s, "tail": float(tails[n, s])} for s in range(n, SQUARES + 1, 2) if 1e-12 < tails[n, s] < 1 - 1e-12]
    held = F.from_json(F.lit(json.dumps(rows)), "array<struct<encoding:string,symbols:int,squares:int,tail:double>>")
    return spark.range(1).select(F.inline(held))


def _two_sided(z: Column) -> Column:
    """The chance of a normal deviate as far from 0 (a logistic approximation, within 0.0002)."""
    a = F.least(F.abs(z), F.lit(8.0))
    return 2 / (1 + F.exp(1.5976 * a + 0.070566 * a * a * a))


def _upper(z: Column) -> Column:
    return F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def statistics(token: Column, kind: Column) -> Column:
    """struct<symbols, letters, squares, runs, serial> of a token: how many symbols, of how many letters, the sum of their squared counts, runs above and below the middle, and the sum of products of neighbours (from the middle)."""
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[kind]
    bare = F.regexp_replace(token, f"[{SEPARATORS}]", "")
    plain = F.when(kind == "base64", F.translate(token, "-_", "+/")).when(kind == "base32", bare).otherwise(F.lower(bare))
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def figures(x: Column) -> Column:
        n, k = F.length(x["t"]), F.length(x["a"])
        squares = F.aggregate(F.split(x["a"], ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise((n - F.length(F.replace(x["t"], c))) * (n - F.length(F.replace(x["t"], c)))).cast("long"))
        middle = (k + 1) / 2
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1).alias("runs"), F.lit(0.0).alias("serial"))
        seen = F.aggregate(
            x["c"],
            start,
            lambda s, c: F.struct(
                (c - middle).alias("last"),
                (s["runs"] + F.when(s["last"].isNotNull() & ((s["last"] > 0) != (c - middle > 0)), 1).otherwise(0)).alias("runs"),
                (s["serial"] + F.coalesce(s["last"] * (c - middle), F.lit(0.0))).alias("serial"),
            ),
        )
        return once(seen, lambda s: F.struct(n.alias("symbols"), k.alias("letters"), squares.alias("squares"), s["runs"].alias("runs"), s["serial"].alias("serial")))

    letters = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))
    return once(F.struct(plain.alias("t"), alphabet.alias("a"), letters.alias("c")), figures)


def with_p_values(tokens: DataFrame, token: str = "token", encoding: str = "encoding") -> DataFrame:
    """tokens with p, the joint p-value of the three tests, and p_chi, p_runs, p_serial."""
    rows = tokens.withColumn("_s", statistics(F.col(token), F.col(encoding)))
    table = chi_table(tokens.sparkSession).select(F.col("encoding").alias("_e"), F.col("symbols").alias("_n"), F.col("squares").alias("_q"), F.col("tail").alias("_tail"))
    # the table's size is fixed
    rows = rows.join(F.broadcast(table), (F.col(encoding) == F.col("_e")) & (F.col("_s.symbols") == F.col("_n")) & (F.col("_s.squares") == F.col("_q")), "left")
    n, k, squares = F.col("_s.symbols").cast("double"), F.col("_s.letters").cast("double"), F.col("_s.squares").cast("double")
    chi, df = k / n * squares - n, k - 1
    z = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    exact = F.coalesce(F.col("_tail"), F.when(squares > n + n * (n - 1) / k, 0.0).otherwise(1.0))
    pairs = F.greatest(n - 1, F.lit(1.0))
    rows = rows.withColumns({
        "p_chi": F.when(n <= EXACT, exact).otherwise(_upper(z)),
        "p_runs": _two_sided((F.col("_s.runs") - 1 - (n - 1) / 2) / F.sqrt(pairs / 4)),
        "p_serial": _two_sided(F.col("_s.serial") / ((k * k - 1) / 12 * F.sqrt(pairs))),
    })
    half = -sum((F.log(F.greatest(F.col(c), F.lit(1e-15))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
    return rows.withColumn("_h", half).withColumn("p", F.exp(-F.col("_h")) * (1 + F.col("_h") + F.col("_h") * F.col("_h") / 2)).drop("_s", "_e", "_n", "_q", "_tail", "_h")


def _bin(p: Column) -> Column:
    """The bin of a p-value; its lower end is 10 ** (bin / STEPS - DECADES)."""
    return F.floor((F.log10(F.greatest(p, F.lit(10.0**-DECADES))) + DECADES) * STEPS).cast("int")


def report_limits(candidates: DataFrame, q: float = 0.05) -> DataFrame:
    """(encoding, scale, limit): the smallest bin of p-values from which a stratum's candidates (encoding, scale, bin) are reported; none where all look structured. At most 4 x 31 rows."""
    own = candidates.groupBy("encoding", "scale", "bin").agg(F.count("*").cast("double").alias("n"))
    pool = own.groupBy("encoding", "bin").agg(F.sum("n").alias("n"))
    pool = pool.select("encoding", "bin", (PRIOR * F.col("n") / F.sum("n").over(Window.partitionBy("encoding"))).alias("share"))
    strata = own.select("encoding", "scale").distinct().join(pool, "encoding")
    counts = strata.join(own, ["encoding", "scale", "bin"], "left").withColumn("c", F.coalesce("n", F.lit(0.0)) + F.col("share"))
    by = Window.partitionBy("encoding", "scale")
    edge = lambda b: F.pow(F.lit(10.0), b / STEPS - DECADES)
    first = math.ceil((math.log10(RANDOM_FROM) + DECADES) * STEPS)
    random = F.sum(F.when(F.col("bin") >= first, F.col("c")).otherwise(0.0)).over(by) / (1 - 10 ** (first / STEPS - DECADES))
    # a limit may lie anywhere above the bin before: right there it costs the fewest random tokens
    low = F.coalesce(edge(F.lag("bin").over(by.orderBy("bin")) + 1), F.lit(0.0))
    counts = counts.withColumns({"random": random, "above": F.sum("c").over(by.orderBy(F.desc("bin"))), "low": low})
    structured = F.greatest(F.col("above") - F.col("random") * (1 - F.col("low")), F.lit(0.0))
    return counts.where(structured <= q * F.col("above")).groupBy("encoding", "scale").agg(F.min("bin").alias("limit"))


def _guarded(body: Column) -> Column:
    """Whether a text can have a span at all."""
    return body.rlike(GUARDS["assign"]) | body.rlike(GUARDS["access"]) | body.rlike(GUARDS["hex"]) | body.rlike(RUN)


def _digest(body: Column) -> Column:
    return F.unhex(F.md5(body))


def found_spans(docs: DataFrame, *, text: str = "text", q: float = 0.05) -> DataFrame:
    """A stashed table (h, spans) of the different texts that have spans; h is the hash of a text."""
    body = F.col("t")
    rows = docs.select(text_of(text).alias("t")).where(_guarded(body))
    rows = rows.select(_digest(body).alias("h"), F.concat(*[_hits(body, *kind) for kind in (*BASE, ("random", RUN, 0, MIN_TOKEN))]).alias("hits"))
    rows = stash(rows.groupBy("h").agg(F.first("hits").alias("hits")), "hits")
    each = rows.where(F.size("hits") > 0).select("h", F.explode("hits").alias("x")).select("h", "x.*")
    in_order = Window.partitionBy("h", "kind").orderBy("i")
    start = F.sum("gap").over(in_order) + F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("n")).where("ok").drop("i", "gap", "ok")
    # candidates that overlap no base span: one sorted pass over a text's spans
    base = F.col("kind") != "random"
    across = Window.partitionBy("h").orderBy("start", "end")
    reached = F.max(F.when(base, F.col("end"))).over(across.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(base, F.col("start"))).over(across.rowsBetween(0, Window.unboundedFollowing))
    free = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(coming >= F.col("end"), F.lit(True))
    each = each.withColumn("free", free).where(base | F.col("free"))
    each = each.withColumn("token", F.regexp_replace("token", "=+$", "")).withColumn("encoding", F.when(~base, encoding(F.col("token"))))
    each = stash(each.select("h", "kind", "start", "end", "token", "encoding", F.floor(F.log2("n")).cast("int").alias("scale")), "spans")
    tested = with_p_values(each.where("kind = 'random' AND encoding IS NOT NULL"))
    tested = stash(tested.select("h", "kind", "start", "end", "encoding", "scale", _bin(F.col("p")).alias("bin")), "tested")
    limits = stash(report_limits(tested, q), "limits")
    kept = tested.join(F.broadcast(limits), ["encoding", "scale"]).where("bin >= limit")  # a row for each stratum
    spans = each.where(base).select("h", "kind", "start", "end").unionByName(kept.select("h", "kind", "start", "end"))
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind")).cast("int") - 1
    found = stash(spans.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")), "found")
    drop(rows, each, tested, limits)
    return found


def scan(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = (), q: float = 0.05) -> DataFrame:
    """The columns in keep, and spans: array<struct<start, rank, end, kind>> in order of start, then kind (rank 0 to 3)."""
    found = found_spans(docs, text=text, q=q)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), _digest(text_of(text)).alias("h"))
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(found, "h", "left").select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The other columns, with n_assign, n_access, n_hex, base_sha256, spans (all, as text) and n_random in place of spans."""
    spans = F.col("spans")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(spans, of_kind(k))).cast("long").alias(f"n_{k}") for k in ORDER]
    as_text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.sha2(as_text(F.filter(spans, lambda s: s["kind"] != "random")), 256)
    return scanned.select(*[c for c in scanned.columns if c != "spans"], *counts[:3], base.alias("base_sha256"), as_text(spans).alias("spans"), counts[3])


def cleaned(body: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by the mark, overlapping ones by one. Many spans are cut out of the text's list of characters, so that the cost grows with the text and not with both."""
    gap = "array<struct<a:bigint,b:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(gap).alias("gaps"))

    def step(a: Column, s: Column) -> Column:
        between = F.array_append(a["gaps"], F.struct(a["at"].alias("a"), s["start"].cast("long").alias("b")))
        return F.struct(F.greatest(a["at"], s["end"].cast("long")).alias("at"), F.when(s["start"] >= a["at"], between).otherwise(a["gaps"]).alias("gaps"))

    size = F.length(body).cast("long")
    gaps = F.aggregate(spans, start, step, lambda a: F.array_append(a["gaps"], F.struct(F.least(a["at"], size).alias("a"), size.alias("b"))))
    few = F.transform(gaps, lambda g: F.substring(body, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    many = F.transform(F.array(F.struct(F.split(body, "").alias("c"), gaps.alias("g"))), lambda x: F.transform(x["g"], lambda g: F.array_join(F.slice(x["c"], (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")), "")))[0]
    return F.array_join(F.when(F.size(spans) <= 32, few).otherwise(many), mark)


def redacted(docs: DataFrame, *, text: str = "text", mark: str = "[REDACTED]", q: float = 0.05) -> DataFrame:
    """docs with every span replaced by the mark (overlapping spans by one), n_chars recounted. Only texts that can have a span take part in the join."""
    found, body, columns = found_spans(docs, text=text, q=q), text_of(text), docs.columns
    size = lambda x: F.length(F.coalesce(x, F.lit(""))).cast("long")
    plain = docs.where(~_guarded(body)).select(*[size(F.col(text)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])
    rows = docs.where(_guarded(body)).select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), body.alias("body"))
    rows = rows.withColumn("h", _digest(F.col("body"))).join(found, "h", "left")
    rows = rows.select("row", F.when(F.size("spans") > 0, cleaned(F.col("body"), F.col("spans"), mark)).otherwise(F.col("body")).alias("clean"))
    return plain.unionByName(rows.select(*[F.col("clean").alias(c) if c == text else size(F.col("clean")).alias(c) if c == "n_chars" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)]))
