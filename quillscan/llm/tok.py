"""Exact token ids at corpus speed.

Both vocabularies split a text into pieces before they merge bytes, and a piece
is encoded without regard to its neighbours. Texts are therefore cut at
boundaries that the vocabulary's own splitter always respects, and each distinct
cut is encoded once by the tokenizers library and kept in a bounded table.
Texts in which such boundaries can't be told cheaply are given to the library
whole, so the ids equal those of a plain encode() in every case.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: Entries of each of the two generations of the table of encoded pieces, and the longest piece that enters it.
LIMIT, LONGEST = 400_000, 64


def _classes() -> bytes:
    """For each Latin-1 character: a for letters and digits, a blank for blanks and line feeds, a stop for stops and commas, NUL for what no fast cut knows, # for the rest."""
    out = []
    for i in range(256):
        kind = unicodedata.category(chr(i))
        out.append("." if chr(i) in ".," else " " if chr(i) in " \n" else "a" if kind[0] in "LN" else "\0" if kind[0] in "ZC" and i != 0xAD else "#")
    return "".join(out).encode()


_CLASSES = _classes()


def look(text: str) -> tuple[bool, bytes | None]:
    """Whether single blanks and line feeds between words are the text's only white space; its classes, if it is Latin-1."""
    try:
        seen = text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        if text[0].isspace() or text[-1].isspace() or not text.replace("\n", "").isprintable():
            return False, None
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text), None
    return not (b"\0" in seen or b"  " in seen or seen[:1] == b" " or seen[-1:] == b" "), seen


_OPEN: dict[tuple[str, str], "Pieces"] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def opened(kind: str, path: str) -> "Pieces":
    """The encoder for a file, once for a Python worker."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = {"byte": BytePieces, "word": WordPieces}[kind](path)
    return _OPEN[kind, path]


class Pieces:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # a text that holds the string of an added token, in any case, goes to the library whole
        self.added = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what self.known was until it was full

    def plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [None if self.holds_added(x) else self.cut(x) for x in texts]
        need: set[str] = set()
        for pieces in cut:
            if pieces is not None:
                need.update(pieces)
        if len(self.known) > LIMIT:
            self.before, self.known = self.known, {}
        missing = [k for k in need if k not in self.known]
        if self.before:
            self.known.update((k, v) for k in missing if (v := self.before.get(k)) is not None)
            missing = [k for k in missing if k not in self.known]
        self.learn(missing)
        get, skip = self.known.__getitem__, self.skip
        out = [self.plain(x) if pieces is None else b"".join(map(get, pieces))[skip:] for x, pieces in zip(texts, cut)]
        for k in missing:
            if len(k) > LONGEST:
                del self.known[k]
        return out

    skip = 0

    def holds_added(self, text: str) -> bool:
        if "<|" not in text and all(x.startswith("<|") for x in self.added):
            return False
        low = text.lower()
        return any(x in low for x in self.added)

    def cut(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def learn(self, missing: list[str]) -> None:
        raise NotImplementedError


class BytePieces(Pieces):
    """Byte-level BPE: a blank belongs to the word after it, a line feed stands alone.

    A piece is named by its text after its blank; names that begin with a line
    feed or U+0002 stand for what follows no blank.
    """

    def __init__(self, path: str):
        super().__init__(path)
        ids = self.model.encode("\n", add_special_tokens=False).ids
        assert len(ids) == 1, "a line feed has to be one token here"
        self.feed = ids[0]
        self.skip = 4

    def cut(self, text: str) -> list[str] | None:
        if not text:
            return ["\n"]
        plain, seen = look(text)
        if not plain:
            return None
        text = ("\n" + text).replace("\n", " \n")
        if seen and not (b"#." in seen or b".." in seen or b" ." in seen or seen[:1] == b"."):
            text = text.replace(".", " \x02.").replace(",", " \x02,")
        return text.split(" ")[1:]

    def learn(self, missing: list[str]) -> None:
        groups: dict[str, list[str]] = {"": [], "\n ": [], "\n": []}
        for k in missing:
            groups["" if k[0] == "\n" else "\n" if k[0] == "\x02" else "\n "].append(k)
        for before, keys in groups.items():
            for i in range(0, len(keys), 4096):
                part = keys[i : i + 4096]
                ids = np.array(self.model.encode("".join([before + k.lstrip("\x02") for k in part]), add_special_tokens=False).ids, "<u4")
                at = np.flatnonzero(ids == self.feed) * 4
                assert len(at) == len(part)
                held = ids.tobytes()
                for k, a, b in zip(part, (at + 4 * bool(before)).tolist(), [*at[1:].tolist(), len(held)]):
                    self.known[k] = held[a:b]


class WordPieces(Pieces):
    """BPE with word ends: white space only separates, letters lose their case."""

    MARK = "\x01"

    def __init__(self, path: str):
        super().__init__(path)
        ids = self.model.encode(self.MARK, add_special_tokens=False).ids
        assert len(ids) == 1
        self.mark = ids[0]
        self.known[""] = b""

    def cut(self, text: str) -> list[str] | None:
        if self.MARK in text:
            return None
        seen = text and look(text)[1]
        if seen and not (b"#." in seen or b".." in seen or b".#" in seen or b"\0" in seen):
            text = text.replace(".", " .").replace(",", " ,").replace(". ", " . ").replace(", ", " , ")
            text = text.lower()  # Latin-1 letters lower alike one by one
        return text.replace("\n", " ").split(" ")

    def learn(self, missing: list[str]) -> None:
        self.known.setdefault("", b"")
        missing = [k for k in missing if k]
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            ids = np.array(self.model.encode("".join([f"{self.MARK} {k} " for k in part]), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(ids == self.mark) * 4
            if len(at) != len(part):  # a piece holds the mark's token some other way
                for k in part:
                    self.known[k] = self.plain(k)
                continue
            held = ids.tobytes()
            for k, a, b in zip(part, (at + 4).tolist(), [*at[1:].tolist(), len(held)]):
                self.known[k] = held[a:b]


def portions(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of texts with about so many characters at most (a longer text alone)."""
    start = held = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and held + n > chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
