"""Plain versions of the operators, for small tables."""

import re
import unicodedata
from collections import Counter, defaultdict

from quillscan.llm import secrets, tok

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def encoder(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tok.vocabulary(name))
    return lambda text: model.encode(text, add_special_tokens=False).ids


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


def quality_keeps(text):
    n, chars, symbols, dup, repeat = figures(text)
    kinds = Counter(unicodedata.category(c) for c in text)
    up, low = kinds["Lu"], kinds["Ll"]
    return not (n < 50 or 2 * repeat > n or 10 * symbols > n or 100 * dup > 30 * len(text.split("\n")) or chars < 2 * n or chars > 20 * n or up > low)


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_classes(rows):
    """Smallest id of each document's class, by all pairs."""
    sets, top = [shingle_set(t) for _, t in rows], list(range(len(rows)))

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


def base_spans(text):
    kinds = [("assign", secrets.ASSIGN.replace("(?i)", ""), 2, 6, re.I), ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0)]
    found = [(m.start(), i, m.end(), k) for i, (k, p, g, n, flags) in enumerate(kinds) for m in re.finditer(p, text, flags) if len(m.group(g)) >= n]
    return sorted(found)


def water(sizes, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target
