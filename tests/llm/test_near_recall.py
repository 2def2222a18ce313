"""Recall of the near-duplicate search on near copies of different text, short and very long ones, and on texts that only share passages."""

import random

from tickweave.llm import near_dedup


def test_near_copies_of_different_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows, pairs, apart, doc = [], [], [], 0

    def changed(text, n):
        text = list(text)
        for k in rng.sample(range(len(text)), n):
            text[k] = rng.choice(words) + "x"
        return text

    for size, many in ((60, 120), (300, 150), (1500, 40), (20_000, 6)):
        for _ in range(many):
            own = rng.choices(words, k=size)
            # Each changed word is in five windows: the similarity is about (1 - 5c) / (1 + 5c) for a share c of changed words.
            rows += [(doc, " ".join(own)), (doc + 1, " ".join(changed(own, max(1, size // 60))))]
            pairs.append((doc, doc + 1))
            doc += 2
    passage = rng.choices(words, k=120)
    for _ in range(60):  # a third of each text is a passage that all share
        rows.append((doc, " ".join(rng.choices(words, k=120) + passage + rng.choices(words, k=120))))
        apart.append(doc)
        doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    texts = dict(rows)
    held = {d: near_dedup.weighted(near_dedup.shingles(t.encode())) for d, t in texts.items()}
    close = [p for p in pairs if near_dedup.similarity(held[p[0]], held[p[1]]) >= 0.8]
    assert len(close) > 250 and sum(got[a] == got[b] for a, b in close) >= 0.99 * len(close)
    assert len({got[d] for d in apart}) == len(apart)
