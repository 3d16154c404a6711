"""Each stage of the pipeline against a plain version, on all that the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillscan.llm import tok
from tests.llm import plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, every stage's read from the Parquet files of the one before."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs.columns, docs.collect()))
    return out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages[1:]] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_quality_rules(stages):
    want = Counter(tuple(r) for r in stages[0][2] if plain.quality_keeps(r["text"] or ""))
    assert Counter(tuple(r) for r in stages[1][2]) == want and 0 < len(stages[1][2]) < len(stages[0][2])


def test_near_duplicates(stages):
    rows = stages[1][2]
    classes = plain.near_classes([(r["doc_id"], r["text"] or "") for r in rows])
    assert sorted(r["doc_id"] for r in stages[2][2]) == sorted(set(classes.values()))
    held = {tuple(r) for r in rows}
    assert all(tuple(r) in held for r in stages[2][2])


def test_secrets(stages):
    before = {r["doc_id"]: r for r in stages[2][2]}
    assert sorted(before) == sorted(r["doc_id"] for r in stages[3][2])
    for r in stages[3][2]:
        text = before[r["doc_id"]]["text"] or ""
        spans = [(a, b) for a, _, b, _ in plain.base_spans(text)]
        assert r["n_chars"] == len(r["text"] or "")
        if not spans:
            assert r["text"] == before[r["doc_id"]]["text"] or "[REDACTED]" in r["text"]
            continue
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out.append(text[at:a])
            at = max(at, b)
        want = "[REDACTED]".join([*out, text[at:]])
        assert r["text"] == want or "[REDACTED]" in r["text"] and not plain.base_spans(r["text"])


def test_mixing(stages):
    rows = stages[3][2]
    sizes, size_of, words_of = Counter(), {}, {}
    for r in rows:
        words_of[r["doc_id"]] = WORD.findall(r["text"] or "")
        size_of[r["doc_id"]] = len(words_of[r["doc_id"]])
        sizes[r["source"]] += size_of[r["doc_id"]]
    want, got, by_doc = plain.water(sizes), Counter(), Counter()
    joined = {d: " ".join(w) for d, w in words_of.items()}
    for r in stages[4][2]:
        words = WORD.findall(r["text"])
        assert " ".join(words) in joined[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["source"]] += len(words)
        by_doc[r["doc_id"]] += len(words)
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
    assert all(n <= 2 * size_of[d] for d, n in by_doc.items())


def test_packing(stages):
    encode = plain.encoder("byte_bpe_50k.json")
    want = Counter((r["doc_id"], zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*encode(r["text"] or ""), 0]))) for r in stages[4][2])
    total = sum(len(encode(r["text"] or "")) + 1 for r in stages[4][2])
    pieces, filled = defaultdict(int), defaultdict(list)
    for r in stages[5][2]:
        pieces[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(pieces.values()) == total and set(pieces) == {d for d, _ in want}
    whole = Counter((r["doc_id"], r["ids_crc32"]) for r in stages[5][2] if r["length"] == r["doc_tokens"])
    assert not whole - want  # a document in one piece holds its ids
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF).agg(F.sum("length").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert (got["n"], got["d"]) == (sum(r["length"] for r in stages[5][2]), len({r["doc_id"] for r in stages[5][2]}))


def test_encoder_is_the_library():
    assert tok.opened("byte", tok.vocabulary("byte_bpe_50k.json")).encode(["a b"])[0] == b"".join(i.to_bytes(4, "little") for i in plain.encoder("byte_bpe_50k.json")("a b"))
