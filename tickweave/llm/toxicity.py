"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, full-width forms, digits that stand for letters) and matched by an
Aho-Corasick automaton of word stems. Stems, their weights and the exception phrases are learnt from labelled
rows: a stem's weight is its log-odds between toxic and other documents; an exception is a phrase (the
matched word with a neighbour, or the word itself) that only other documents hold. Sums of weights per
hundred words, and whether there is any match, go through a logistic curve fitted on the same labelled rows.

Stems are the first SHORTEST to LONGEST letters of words. What is learnt is bounded by MAX_LABELLED labelled rows
and by nothing else; every text is scored in whole.

Defined results: a null or empty text has no hits and scores as such; very long texts are read in whole; repeated
rows score alike; documents without a label are scored too; repeated labels of a document count once, at the
largest; an empty table gives no rows; further columns are never read. Without any toxic label every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import staged, text_of

#: Documented bound of the labelled rows that the lexicon and the curve are fitted on.
MAX_LABELLED = 30_000
SHORTEST, LONGEST = 4, 9
MIN_TOXIC, MIN_ODDS = 5, 2.5
EXCEPTION_MIN = 3
#: Letters of other scripts, and digits and signs, that look like Latin letters.
LOOKS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_FOLD = {ord(k): v for k, v in LOOKS.items()} | {c: chr(c - 0xFEE0).lower() for c in range(0xFF10, 0xFF5B)} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF])
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def stems_of(text: str) -> set[str]:
    words = set(WORD.findall(fold(text)))
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


@dataclass
class Lexicon:
    """stem -> weight, phrases that excuse a match, and the curve's constants (bias, any match, sum per hundred words)."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem in self.weights:
            found.add_word(stem, stem)
        found.make_automaton()
        return found

    def hits(self, automaton, folded: str) -> list[tuple[str, str, str, str]]:
        """(stem, word, word before, word after) of each match at a word's start; of nested stems the longest."""
        if not self.weights:
            return []
        best: dict[int, str] = {}
        for end, stem in automaton.iter(folded):
            start = end - len(stem) + 1
            if (start == 0 or not folded[start - 1].isalnum()) and len(stem) > len(best.get(start, "")):
                best[start] = stem
        if not best:
            return []
        words = [(m.start(), m[0]) for m in WORD.finditer(folded)]
        at = {start: k for k, (start, _) in enumerate(words)}
        word = lambda k: words[k][1] if 0 <= k < len(words) else ""
        return [(stem, word(at[start]), word(at[start] - 1), word(at[start] + 1)) for start, stem in best.items()]

    def measure(self, automaton, text: str) -> tuple[int, float, float]:
        """Hits, damped sum of weights, sum per hundred words."""
        folded = fold(text)
        counts: Counter[str] = Counter()
        for stem, word, before, after in self.hits(automaton, folded):
            if not {word, f"{before} {word}", f"{word} {after}"} & self.exceptions:
                counts[stem] += 1
        total = sum(self.weights[s] * (1 + math.log(n)) for s, n in counts.items())
        return sum(counts.values()), total, 100 * total / (len(text.split()) + 100) if total else 0.0


def choose(features: list[tuple[str, int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Stems by a lower bound of their log-odds, the more frequent first; of a stem and its extensions only the most telling stays."""
    scored = []
    for stem, a, b in features:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_other + 1))
        sure = odds - 1.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= MIN_TOXIC and sure >= MIN_ODDS:
            scored.append((round(sure + 0.3 * math.log(a), 9), len(stem), stem, odds))
    out: dict[str, float] = {}
    begun: set[str] = set()  # the beginnings of those chosen
    for _, _, stem, odds in sorted(scored, reverse=True):
        if stem not in begun and not any(stem[:k] in out for k in range(SHORTEST, len(stem))):
            out[stem] = odds
            begun.update(stem[:k] for k in range(SHORTEST, len(stem) + 1))
    return out


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients of a logistic curve by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic); only labelled rows given here are read."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Written once: learning reads these rows four times, and the documents are many more.
    own = staged(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id"), "labelled")
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = n.get(1, 0), sum(v for k, v in n.items() if k != 1)

    def features(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for t, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for stem in stems_of(t):
                    counts.setdefault(stem, [0, 0])[toxic != 1] += 1
            yield pa.RecordBatch.from_pydict({"stem": list(counts), "a": [c[0] for c in counts.values()], "b": [c[1] for c in counts.values()]}, pa.schema([("stem", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    found = own.select("text", "toxic").mapInArrow(features, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Only stems of several toxic rows with clear odds leave the executors; the labelled rows bound them.
    clear = found.filter((F.col("a") >= MIN_TOXIC) & (F.col("a") * max(n_other, 1) > 7 * F.col("b") * max(n_toxic, 1)))
    lexicon = Lexicon(choose([tuple(r) for r in clear.collect()], n_toxic, n_other))

    def phrases(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for t, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for _, word, before, after in lexicon.hits(automaton, fold(t)):
                    for phrase in (word, f"{before} {word}", f"{word} {after}"):
                        counts.setdefault(phrase, [0, 0])[toxic != 1] += 1
            yield pa.RecordBatch.from_pydict({"phrase": list(counts), "a": [c[0] for c in counts.values()], "b": [c[1] for c in counts.values()]}, pa.schema([("phrase", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    spoken = own.select("text", "toxic").mapInArrow(phrases, "phrase string, a long, b long").groupBy("phrase").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lexicon.exceptions = {r["phrase"] for r in spoken.filter((F.col("a") == 0) & (F.col("b") >= EXCEPTION_MIN)).collect()}

    sums = own.select("toxic", "text").mapInArrow(_measures(lexicon, ["toxic"]), "toxic int, n_hits long, total double, density double")
    # At most some 20,000 different points, whatever the rows: sums over 100 lie where the curve is flat.
    seen = sums.groupBy("toxic", (F.col("total") > 0).alias("any"), F.least(F.round("density", 2), F.lit(100.0)).alias("density")).agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "any", "density").toPandas()
    if n_toxic and len(seen):
        x = np.column_stack([np.ones(len(seen)), seen["any"], seen.density])
        lexicon.curve = logistic(x.astype(float), (seen.toxic == 1).to_numpy(float), seen.n.to_numpy(float))
    return lexicon


def _measures(lexicon: Lexicon, keep: list[str]):
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [lexicon.measure(automaton, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], [*keep, "n_hits", "total", "density"])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_hits, score for every row of docs."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_measures(lexicon, ["doc_id"]), "doc_id long, n_hits long, total double, density double")
    a, b, c = lexicon.curve
    curve = F.lit(a) + F.when(F.col("total") > 0, F.lit(b)).otherwise(F.lit(0.0)) + F.lit(c) * F.col("density")
    return found.select("doc_id", "n_hits", (1 / (1 + F.exp(-curve))).alias("score"))
