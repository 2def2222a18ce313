"""Packing against the tokenizers library: every id in one piece, no gaps, little padding."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickweave.llm import packing, registry
from tickweave.llm.range_coder import tokenise

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


TOKENIZER = Tokenizer.from_file(WORDS)


def ids_of(texts, end=packing.END_ID):
    found = TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in found]


def check(rows, texts_by_doc, size=packing.SIZE):
    """rows: of the query; texts_by_doc: doc_id -> texts of the rows with that id."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(sequences) == list(range(len(sequences)))
    total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total += at
    for doc, texts in texts_by_doc.items():
        want, own = Counter(), Counter(pieces.pop(doc))
        for ids in ids_of(texts):
            cuts = sorted({s for n, s, _, _ in own if n == len(ids)} | {len(ids)})
            assert cuts[0] == 0
            want.update((len(ids), a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:]))
        assert own == want
    assert not pieces
    return len(sequences) * size - total, total


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {}
    for d in docs:
        texts.setdefault(d["doc_id"], []).append(d["text"])
    padding, total = check(registry.queries()["op13_packing"](spark, SF).collect(), texts)
    assert padding < packing.SIZE + packing.MAX_PADDING * total


@pytest.mark.parametrize("size", [64, 256, 48])
def test_small_sequences_with_cuts_nulls_repeats_and_clashing_columns(spark, size):
    rng = random.Random(size)
    texts = [None, "", "word", "a b " * 500, "x" * 3000, "é日本 ß ", "  "] + [" ".join(rng.choice(["alpha", "be", "gamma7", "Δ"]) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    texts += [texts[9]] * 40
    rows = [(None if i == 5 else i // 2, t, 1, 2, 3, "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, task int, length int, rank int, marks string, before int").repartition(5)
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r[1])
    out = packing.pack(docs, WORDS, size=size)
    padding, total = check(out.collect(), own, size)
    assert padding < size + total * 0.02


def test_parts_of_any_length_have_their_checksums(spark):
    """Pieces of just over half a sequence don't fit together: they are cut, and checksums follow from the marks."""
    texts = ["ab " * (40 + i % 3) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = packing.pack(docs, WORDS, size=64)
    rows = found.collect()
    assert any(r["length"] < r["doc_tokens"] for r in rows)
    padding, total = check(rows, {i: [t] for i, t in enumerate(texts)}, 64)
    assert padding < 64 + total * packing.MAX_PADDING


def test_empty_table(spark):
    out = packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS)
    assert out.collect() == [] and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_patterns_hold_each_part_once():
    rng = random.Random(1)
    for size in (64, 256):
        for _ in range(15):
            hist = {rng.randint(1, size): rng.randint(1, 20) for _ in range(rng.randint(1, 60))}
            parts = Counter()
            patterns = packing.packed(hist, size)
            for p in patterns:
                assert p.fill == sum(s[3] for s in p.slots()) <= size
                for length, rank, start, part in p.slots():
                    for k in range(p.count):
                        parts.update((length, rank + k, x) for x in range(start, start + part))
            assert parts == Counter((length, rank, x) for length, n in hist.items() for rank in range(n) for x in range(length))


def test_pieces_of_the_greatest_counts_take_no_longer():
    hist = {k: 10**9 + k for k in range(1, 4097)}
    found = packing.packed(hist)
    tokens = sum(k * n for k, n in hist.items())
    assert sum(p.count for p in found) * 4096 - tokens <= packing.MAX_PADDING * tokens


def test_checksum_of_what_follows_a_head():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (7, 4000), (16, 3), (500, 65_536)):
        head, rest = rng.integers(0, 1 << 32, n, np.uint64).astype("<u4").tobytes(), rng.integers(0, 1 << 32, m, np.uint64).astype("<u4").tobytes()
        found = packing.crc_of_rest(np.array([zlib.crc32(head + rest)]), np.array([zlib.crc32(head)]), np.array([m]))
        assert found.tolist() == [zlib.crc32(rest)]


def test_words_are_encoded_as_the_library_does():
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x250)] + ["'s", "'LL", "don't", " ", "\n", "\t", "İ", "Σ", "ς", "日", "é", "́", "<|endoftext|>", "<|StartOfText|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    found = [np.frombuffer(b, "<u4").tolist() for b in tokenise(texts, WORDS)]
    assert found == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
