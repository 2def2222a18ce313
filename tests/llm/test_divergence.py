"""The divergence audit against plain Python, and transducers against a sorted list."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tickweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t, n in df.items() if n >= min_docs}
        c = {s: Counter() for s in {d[1] for d in own}}
        for _, s, n in own:
            c[s].update({t: k for t, k in n.items() if t in kept})
        whole = Counter()
        for n in c.values():
            whole.update(n)
        v = len(kept)
        share = lambda n, t: 1 + 1_000_000_000 * (n[t] + 1) // (sum(n.values()) + v)
        p = {s: {t: share(n, t) for t in kept} for s, n in c.items()}
        q = {t: share(whole, t) for t in kept}
        for s in c:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in c if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if c[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abAB'é日ß1_") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["a", "ab", "abc", "Z" * 400]
    text = lambda: rng.choice([" ", "\n", "9", "--"]).join(rng.choices(words, k=rng.randint(0, 40)))
    made = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "Ü", None, "s2b"]), text()) for _ in range(70)]
    made += [("xx", "s1", "only once here"), ("xx", "s2", None), ("xx", "s3", "1 2 3"), ("yy", "alone", ""), ("zz", "s1", "same same"), ("zz", "s1", "same"), ("zz", "s2", "same"), made[3], made[3]]
    made += [("en", "s1", "word " * 300_000)] * 3
    return made


@pytest.mark.parametrize("sent", [False, True])
def test_against_plain_python(spark, rows, sent):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "lang string, source string, text string, n long, term string").repartition(4)
    found = divergence.audit(docs, broadcast_bytes=0 if sent else divergence.BROADCAST_BYTES, shard_terms=7 if sent else 1 << 16, top=12)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, top=12)


def test_several_transducers_in_every_task(spark, rows):
    docs = spark.createDataFrame(rows[:70], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs, shard_terms=5).collect())) == brute(rows[:70])


def test_sums_of_pairs_in_blocks(spark, rows):
    docs = spark.createDataFrame(rows[:70], "lang string, source string, text string")
    own = divergence.own_columns(docs)
    words = divergence.vocabulary(own)
    counts = divergence.recounted(own, words)
    groups = divergence.groups_of(own, words, counts)
    assert divergence.height(5, 11) == 2
    names = {(r["lang"], r["sid"]): r["source"] for r in groups.collect()}
    found = {(r["lang"], names[r["lang"], r["a"]], names[r["lang"], r["b"]]): r["value"] for r in divergence.pair_sums(divergence.shares(counts, groups), groups, 11).collect()}
    assert found == {(r[0], r[1], r[3]): r[4] for r in brute(rows[:70]) if r[2] == "pair"}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_transducers_number_terms_in_order_and_share_states():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)})
    machine = divergence.Transducer.load(divergence.Transducer.of(terms).dump())
    others = [t + b"q" for t in terms] + [t[:-1] for t in terms if t[:-1] not in set(terms) and len(t) > 1 and b" " not in t]
    text = np.frombuffer(b" ".join(terms + others) + b" ", np.uint8)
    found = machine.ordinals(text, divergence.starts_of(text))
    assert found[: len(terms)].tolist() == list(range(len(terms)))
    assert (found[len(terms) :] == -1).all()
    ends = sorted(p + s for p in (b"walk", b"talk", b"balk") for s in (b"", b"ed", b"er", b"ing", b"s"))
    small = divergence.Transducer.of(ends)
    assert len(small.final) == 2 + 3 + 5 and small.n == len(ends)  # root, w, l, k, the shared l, k and ends, once each
