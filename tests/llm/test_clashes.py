"""Columns of the user's that bear the operators' own names come through; every character is split as the library splits it."""

import base64

import public_tokenizers
import tiktoken

from tickweave.llm import bpe, exact_dedup, near_dedup, quality_rules

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = "one two three four five six seven eight nine ten " * 3
ROWS = [(1, TEXT, "f1", 11, "t1", "w1", "l1", 5), (2, TEXT, "f2", 12, "t2", "w2", "l2", 6), (3, TEXT + "more words here", "f3", 13, "t3", "w3", "l3", 7), (4, None, "f4", 14, "t4", "w4", "l4", 8)]
SHAPE = "doc_id long, text string, at_file string, at_row long, _text string, _words string, _lines string, n_words int"


def written(spark, rows=ROWS):
    path = exact_dedup.scratch(spark, "clash")
    spark.createDataFrame(rows, SHAPE).write.parquet(path)
    return spark.read.parquet(path)


def test_exact_dedup(spark):
    for docs in (written(spark), spark.createDataFrame(ROWS, SHAPE)):
        assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.decide(docs).collect()} == {(1, 2, False), (2, 2, True), (3, 3, True), (4, 4, True)}
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == ROWS[1:]


def test_near_dedup(spark):
    docs = written(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(ROWS) and 1 in {r["doc_id"] for r in kept.collect()}


def test_byte_bpe(spark):
    docs = written(spark)
    back = bpe.round_trip(docs, BPE)
    assert {r["doc_id"]: (r["_text"], bytes(r["decoded"]).decode()) for r in back.collect()} == {r[0]: (r[4], r[1] or "") for r in ROWS}
    assert {r["_text"] for r in bpe.encode(docs, BPE).collect()} == {"t1", "t2", "t3", "t4"}


def test_quality_ledger(spark):
    docs = written(spark)
    found = quality_rules.ledger(docs.drop("n_words"))
    assert {(r["_words"], r["_lines"]) for r in found.collect()} == {(r[5], r[6]) for r in ROWS}
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_every_character():
    coder = bpe.encoder(BPE)
    with open(BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 64 == 0)]
    texts = ["".join(f"a{chr(c)}a {chr(c)}1{chr(c)}. " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for k in range(0, len(texts), 512):
        ids, counts, _ = coder.encode(texts[k : k + 512])
        at = 0
        for text, n in zip(texts[k : k + 512], counts, strict=True):
            assert ids[at : at + n].tolist() == library.encode_ordinary(text)
            at += n
