"""URL filtering by a bit-parallel wildcard automaton.

Glob rules (* any run, ? any character) are laid one after the other over
machine words: a bit for each state of each rule. A character moves all rules at
once: states advance by a shift where the character's mask allows it, and states
behind a * stay. A batch of URLs advances together, one character of each at a
time, so the work for a URL does not depend on the number of rules but on the
number of words.

A URL's canonical form is "." + host + a break + path, the host in lower case; the
break is a code beyond Unicode, so nothing in a URL is taken for it. A host rule
such as example.net/en/ becomes the glob *.example.net<break>/en/*: it holds for
the host and its subdomains, and for paths that start with its own. The longest
host rule wins, the first of equals; where none holds, a blocking glob decides,
else the URL is allowed.

Null URLs and those without :// have an empty host and an empty path. URLs are
judged whole, however long; repeated rows are judged each; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import ship

BREAK = 0x110000  #: the code between host and path
STATES = 4_000_000  #: words of states that a batch of URLs holds at once
MOST_GLOBS = 100_000  #: globs that are read from a table
#: Host rules of the registered query: (verdict, rule).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Globs over the canonical form that block where no host rule holds.
BLOCK_GLOBS = ("*.spam-farm.*", "*.cheap-pills.*", "*.casino*", "*.porn*", "*/wp-login.php*", "*/cgi-bin/*")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Automaton:
    """Globs are strings, or sequences of characters and codes."""

    def __init__(self, globs: Sequence[Sequence[str | int]]):
        states, literal, loops, starts, finals = 0, [], [], [], []
        for glob in globs:
            starts.append(states)
            literal.append(None)  # a start is never entered
            for c in glob:
                if c == "*":
                    loops.append(states)
                else:
                    states += 1
                    literal.append(c if c == "?" or isinstance(c, int) else ord(c))
            finals.append(states)
            states += 1
        self.words = -(-states // 64)
        letters = sorted({c for c in literal if c not in (None, "?")})
        self.letters = np.array(letters, "u4")
        # mask 0 is for characters that no rule names
        self.masks = np.stack([self._bits(i for i, c in enumerate(literal) if c in (x, "?")) for x in ["?", *letters]])
        self.starts, self.loops = self._bits(starts), self._bits(loops)
        self.finals = [(f // 64, np.uint64(f % 64)) for f in finals]

    def _bits(self, at) -> np.ndarray:
        out = np.zeros(self.words, "u8")
        for i in at:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def match(self, texts: list[str], breaks: np.ndarray | None = None) -> np.ndarray:
        """(texts, rules) bool: which rules match a whole text. breaks: the place in each text that holds the break."""
        at_once = max(1, STATES // self.words)
        parts = [self._match(texts[i : i + at_once], None if breaks is None else breaks[i : i + at_once]) for i in range(0, len(texts), at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.finals)), bool)

    def _match(self, texts: list[str], breaks: np.ndarray | None) -> np.ndarray:
        """Texts advance in order of length, so none is padded."""
        n = len(texts)
        sizes = np.array([len(x) for x in texts], "i8")
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.cumsum(sizes) - sizes
        if breaks is not None:
            flat = flat.copy()
            flat[begin + breaks] = BREAK
        at = np.searchsorted(self.letters, flat)
        at = np.where((at < len(self.letters)) & (self.letters[np.minimum(at, len(self.letters) - 1)] == flat), at + 1, 0) if len(self.letters) else np.zeros(len(flat), "i8")
        begin = begin[order]
        state = np.tile(self.starts, (n, 1))
        left = sizes[order]
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-left, -i, "left"))  # those longer than i
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = moved & self.masks[at[begin[:live] + i]] | s & self.loops
        out = np.empty((n, len(self.finals)), bool)
        for r, (word, bit) in enumerate(self.finals):
            out[order, r] = state[:, word] >> bit & one
        return out


def globs_of(table: DataFrame, column: str = "glob") -> list[str]:
    """The globs of a table or file (spark.read.text gives column value), in order; MOST_GLOBS at most."""
    found = table.select(F.col(column).cast("string").alias("g")).where("length(g) > 0").distinct().limit(MOST_GLOBS + 1).collect()
    if len(found) > MOST_GLOBS:
        raise ValueError(f"more than {MOST_GLOBS} globs")
    return sorted(r["g"] for r in found)


def judge(pages: DataFrame, *, url: str = "url", keep: Sequence[str] = (), host_rules: Sequence[tuple[str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """The columns in keep, then host, path, rule, verdict, and glob, the first blocking glob that matches."""
    ship(pages.sparkSession)
    for verdict, rule in host_rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a host rule: {rule}")
    globs: list[Sequence[str | int]] = []
    for _, rule in host_rules:
        name, _, path = rule.partition("/")
        globs.append([*"*.", *name, BREAK, "/", *path, "*"])
    globs += block_globs
    by_length = sorted(range(len(host_rules)), key=lambda i: (len(host_rules[i][1]), -i))  # a later one that holds takes the place of an earlier one
    host, path = url_parts(F.col(url).cast("string"))
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), host.alias("host"), path.alias("path"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string, glob string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            hosts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = automaton.match([f".{h} {p}" for h, p in zip(hosts, paths)], np.array([1 + len(h) for h in hosts], "i8"))
            winner, blocked = np.full(len(hosts), -1), np.full(len(hosts), -1)
            for i in by_length:
                winner[found[:, i]] = i
            for g in range(len(block_globs) - 1, -1, -1):
                blocked[found[:, len(host_rules) + g]] = g
            rule = [host_rules[w][1] if w >= 0 else None for w in winner]
            glob = [block_globs[g] if g >= 0 else None for g in blocked]
            verdict = [host_rules[w][0] if w >= 0 else "block" if g >= 0 else "allow" for w, g in zip(winner, blocked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, "string"), pa.array(verdict, "string"), pa.array(glob, "string")], [*batch.schema.names, "rule", "verdict", "glob"])

    judged = rows.mapInArrow(work, out)
    return judged.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict", "glob")


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN contains('.' || host, '.spam-farm.') OR contains(path, '.spam-farm.') THEN '*.spam-farm.*'
  WHEN contains('.' || host, '.cheap-pills.') OR contains(path, '.cheap-pills.') THEN '*.cheap-pills.*'
  WHEN contains('.' || host, '.casino') OR contains(path, '.casino') THEN '*.casino*'
  WHEN contains('.' || host, '.porn') OR contains(path, '.porn') THEN '*.porn*'
  WHEN contains(path, '/wp-login.php') THEN '*/wp-login.php*'
  WHEN contains(path, '/cgi-bin/') THEN '*/cgi-bin/*' END AS "glob" FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN r."glob" IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, r."glob" FROM r
"""
