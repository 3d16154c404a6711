import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillscan.llm import packing, tok, token_counts, wavelet


def plain(kind):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tok.vocabulary({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind]))
    return lambda text: model.encode(text, add_special_tokens=False).ids


def test_cut_texts_encode_like_whole_ones():
    random.seed(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\n\n", ".", ",", "...", "'s", "é", "Σ", "\t", "9", "#", "\xa0", "\x1c", "日本", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", " .", "\x01", "\x02", "ß", "\r\n", "İ", "x" * 70]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    for kind in ("byte", "word"):
        encode = plain(kind)
        model = tok.opened(kind, tok.vocabulary({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind]))
        for text, ids in zip(texts, model.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == encode(text), repr(text)


def test_length_histogram_answers_every_limit(documents, docs_list, empty):
    encode = plain("byte")
    sizes = [len(encode(text)) for _, text, _ in docs_list]
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(documents)).cache()
    found = {r["length"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in found.items()} == Counter(sizes)
    for limit, r in found.items():
        assert r["truncated_total"] == sum(min(s, limit) for s in sizes)
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(s > limit for s in sizes), sum(s for s in sizes if s > limit))
        assert (r["docs_upto"], r["tokens_upto"]) == (len(sizes) - r["docs_longer"], sum(sizes) - r["tokens_longer"])
    limits = [0, 7, 100, 1000, 10**6]
    for r in token_counts.answer(sums, limits).collect():
        assert (r["docs_cut"], r["tokens_kept"]) == (sum(s > r["limit"] for s in sizes), sum(min(s, r["limit"]) for s in sizes))
    ranked = sorted(sizes)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == ranked[int(np.ceil(r["share"] * len(ranked))) - 1]
    assert token_counts.with_suffix_sums(token_counts.length_histogram(empty)).count() == 0


def test_pieces_cover_each_id_once(documents, docs_list, empty):
    encode = plain("byte")
    rows = packing.pack(documents, with_ids=True).collect()
    at_sequence = defaultdict(list)
    per_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        at_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for doc, text, _ in docs_list:
        want = np.array(encode(text) + [0], "<u4").tobytes()
        pieces = sorted(per_doc[doc])
        if doc != 900005:  # two rows of one id
            assert b"".join(p for _, p, _ in pieces) == want
            assert {n for *_, n in pieces} == {len(want) // 4}
    total = padded = 0
    for pieces in at_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
        total += end
        padded += end if end & (end - 1) == 0 else 1024
    assert total == sum(len(p) // 4 for ps in per_doc.values() for _, p, _ in ps)
    assert padded <= 1.02 * total
    full = [r for r in rows if r["class"] > 0]
    assert all(n == k for (_, k), n in Counter((r["sequence_id"], r["class"]) for r in full).items())  # a fixed count in each class
    assert packing.pack(empty).count() == 0


def test_wavelet_matrix_reads_like_the_list():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (700, 5), (5000, 49407)):
        ids = rng.integers(0, most, n) if n else np.zeros(0, int)
        held = ids.tolist()
        m = wavelet.WaveletMatrix(wavelet.build(np.array([4]), np.array([True]), np.array([n]), ids.astype("<u4")))
        assert m.decode().tolist() == held
        for i in range(0, n, max(1, n // 40)):
            token = held[i]
            assert m.access(i) == token
            assert m.rank(token, i) == held[:i].count(token)
            assert m.select(token, held[:i].count(token)) == i
        assert m.count(most + 70000) == 0 and m.count(held[0] if n else 3) == held.count(held[0] if n else 3)


def test_access_reads_few_blocks(tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49407, 400_000)
    made = wavelet.build(np.array([4, 5]), np.array([True, False]), np.array([150_000, 250_000]), ids.astype("<u4"))
    (tmp_path / "one.qswm").write_bytes(made)
    with open(tmp_path / "one.qswm", "rb") as f:
        m = wavelet.WaveletMatrix(f)
        opened = m.bytes_read
        assert opened < 0.05 * len(made)
        assert m.access(123_456) == ids[123_456]
        assert m.bytes_read - opened <= m.bits * 1.1 * wavelet.SPAN  # a block of each plane, of some 12
        before = m.bytes_read
        assert m.rank(int(ids[7]), 300_000) == (ids[:300_000] == ids[7]).sum()
        assert m.select(int(ids[7]), 0) == np.flatnonzero(ids == ids[7])[0]
        assert m.bytes_read - before <= 6 * m.bits * 1.1 * wavelet.SPAN
        names, known, sizes = m.documents()
        assert known.tolist() == [True, False] and names[0] == 4 and sizes.tolist() == [150_000, 250_000]
        assert (m.decode() == ids).all()


def test_null_ids_and_export(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b"), (3, None), (3, "c"), (1, "")], "doc_id long, text string")
    files = wavelet.write(df)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in wavelet.read(files).collect())
    assert [d for _, d, _ in rows] == [None, 1, 3, 3] and rows[0][0] == 0
    n = wavelet.export(files, str(tmp_path))
    assert n == files.count() == len(list(tmp_path.glob("*.qswm")))
    with open(next(tmp_path.glob("*.qswm")), "rb") as f:
        m = wavelet.WaveletMatrix(f)
        assert m.access(0) == m.decode()[0]


def test_wavelet_files_round_trip(documents, docs_list, empty):
    encode = plain("word")
    files = wavelet.write(documents, shard_tokens=20000)
    assert files.count() > 4
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read(files).collect())
    assert [d for _, d, _, _ in found] == sorted(d for d, _, _ in docs_list)
    start, texts = 0, {d: t for d, t, _ in docs_list}
    for at, doc, n, crc in found:
        ids = np.array(encode(texts[doc]) + [1], "<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
    assert wavelet.read(wavelet.write(empty)).count() == 0
