"""The pipeline's stages against plain Python on the smallest tables."""

import pandas as pd
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm import brute
from tickweave.llm import bpe, exact_dedup, quality_rules
from tickweave.llm.base import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-stage")
        seen.append((name, docs.toPandas()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (_, quality), (_, exact), (_, near), (_, mixed), (_, encoded) = seen
    assert not any(brute.op2(t)[5] for t in quality.text)
    best = {}
    for r in quality.itertuples():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert dict(zip(exact.text, exact.doc_id, strict=True)) == best
    assert set(near.doc_id) <= set(exact.doc_id) and near.doc_id.is_unique
    assert set(mixed.doc_id) <= set(near.doc_id)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sorted(encoded.doc_id) == sorted(mixed.doc_id)
    assert all(brute.op10(texts[r.doc_id], enc) == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.itertuples())


def test_near_stage_drops_only_documents_like_a_kept_one(spark):
    docs = exact_dedup.keep_one(quality_rules.keep_good(spark.read.parquet(f"{SF}/documents.parquet")))
    docs = staged(docs, "near-input")
    kept = set(corpus_pipeline.near(spark, docs, SF).toPandas().doc_id)
    sets = {r.doc_id: {tuple(r.text.split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for r in docs.collect()}
    alike = lambda a, b: len(a & b) / len(a | b)
    pairs = pd.DataFrame([(a, b, alike(sets[a], sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]], columns=["a", "b", "j"])
    close = pairs[pairs.j >= 0.8]
    assert all(not {r.a, r.b} <= kept for r in close.itertuples())
    assert set(sets) - kept <= set(close.a) | set(close.b)


def test_stages_on_edges(spark):
    """Null, empty and very long texts, null and repeated ids, ties, clashing columns; and an empty table."""
    prose = " ".join(f"word{i % 97} of{i % 13} story{i}" for i in range(60))
    long = " ".join(f"part{i % 1009} and{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (4, prose + " end"), (None, "another " + prose), (5, long), (6, long + " more"), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, label string, words string, kept boolean, n_tokens long, copies long, fail_bits long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "d", "k", "l", "w", False, 1, 7, 3) for i, t in rows], kind)
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "edge-stage")
        assert docs.columns == columns
        kept.append(sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect()))
        assert {(r.digest, r.key, r.label, r.words, r.kept, r.n_tokens, r.copies, r.fail_bits) for r in docs.collect()} <= {("d", "k", "l", "w", False, 1, 7, 3)}
    quality, exact, near, _ = kept
    assert quality == sorted([(3, len(prose))] * 2 + [(4, len(prose) + 4), (0, len(prose) + 8), (5, len(long)), (6, len(long) + 5)])
    assert exact == sorted([(3, len(prose)), (4, len(prose) + 4), (0, len(prose) + 8), (5, len(long)), (6, len(long) + 5)])
    assert near == [(3, len(prose)), (5, len(long))], "of each class the least id stays, rows without an id last"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0, name
