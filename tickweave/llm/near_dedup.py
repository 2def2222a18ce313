"""Near-duplicate detection by consistent weighted sampling.

A document is the weighted set of its five-word shingles. A shingle's TF-IDF weight is 1 + ln(its count) times its
inverse document frequency. (Plain counts would call texts alike that share nothing but one line, repeated.)
Improved consistent weighted sampling draws K samples of that set, so that two documents agree in a sample with
probability equal to their weighted Jaccard similarity. Samples are banded; documents that share a band are
candidates, and are verified by their exact weighted Jaccard similarity. Two texts are linked where that is
THRESHOLD or more under the TF-IDF weights, or under 1 + ln(count) alone: whether two texts are alike can then
never be undone by how often the rest of the corpus says the same.

Inverse document frequency runs from 1 (a shingle of one document) to MIN_IDF (a shingle of all): a plain
logarithm would weigh the few words in which members of a large group differ so much more than the words
they share that the group would fall apart. Frequencies are counted over all documents in hashed slots of fixed
number.

Equal word sequences are collapsed first. In each band's bucket every member is verified against one hub,
one edge a member. Buckets that hold more than one connected class after that try HUBS further hubs, each the
member most like the one before. What is of different classes even then is searched by what sets it apart from
the middle of the bucket (see `nearest_pairs` and `apart`), which finds every pair that is left without trying all.
So a bucket of n alike costs a multiple of n, and no link between classes is lost.

Defined results: null texts count as empty; all texts without words form one class; a text of fewer than
five words has one shingle, its words; very long texts are read in whole; repeated rows share a class; an empty
table gives no rows; further columns are ignored. The class id is the least doc_id in the class.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import located, small_side, staged, text_of

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 5
#: Further hubs that a bucket of several classes tries before its remaining pairs are searched; they save work there, and change no result.
HUBS = 1
SLOTS = 1 << 18
MIN_IDF = 0.8
#: Rows of the table of random draws; a shingle's draws are those of its slot there.
DRAWS = 1 << 14
#: Texts of which a two are alike differ by at most this share of their weights' sum.
SLACK = (1 - THRESHOLD) / (1 + THRESHOLD)
#: Members of a bucket from which its centre is taken, about.
SAMPLE = 32
#: Bytes of text hashed at once.
SLICE = 1 << 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes):
    """The text in slices of about SLICE bytes, cut at blanks."""
    first = 0
    while len(text) - first > SLICE and (cut := _BLANK.search(text, first + SLICE)):
        yield text[first : cut.start()]
        first = cut.end()
    yield text[first:]


def text_key(text: bytes) -> bytes:
    """Known by 128 bits of a digest: the words of a text (bytes.split cuts at blank, tab, line feed, vertical tab, form feed and carriage return)."""
    digest, lead = hashlib.sha256(), b""
    for part in _slices(text):
        if words := part.split():
            digest.update(lead + b" ".join(words))
            lead = b" "
    return digest.digest()[:16]


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit number for each byte, and which bytes separate words."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return np.random.default_rng(21).integers(0, 1 << 64, 256, np.uint64), blank


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo 2 ** 64, for k below n."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where each starts: polynomials over its bytes, as differences of prefix sums."""
    letters, blank = _letters()
    own = np.frombuffer(text, np.uint8)
    gaps = np.ones(len(own) + 2, bool)
    gaps[1:-1] = blank[own]
    turns = np.flatnonzero(gaps[1:] != gaps[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(1 << max(12, len(own).bit_length()))
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(letters[own] * up[: len(own)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9), starts


def _windows(words: np.ndarray, wide: int) -> np.ndarray:
    n = len(words) - wide + 1
    out = np.full(n, wide, np.uint64)
    for k in range(wide):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the windows of WORDS words; of all words where there are fewer."""
    words = np.concatenate([word_hashes(part)[0] for part in _slices(text)])
    return _windows(words, min(WORDS, len(words))) if len(words) else words.view(np.int64)


def all_shingles(texts: list[bytes]):
    """shingles of each text in turn; short texts are hashed side by side."""
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) < SLICE):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == first + 1:
            yield shingles(texts[first])
        else:
            words, starts = word_hashes(b"\n".join(texts[first:stop]))
            lengths = np.array([len(t) + 1 for t in texts[first:stop]])
            bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])).tolist()
            whole = _windows(words, WORDS) if len(words) >= WORDS else words[:0].view(np.int64)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield whole[a : b - WORDS + 1] if b - a >= WORDS else _windows(words[a:b], b - a) if b > a else words[:0].view(np.int64)
        first = stop


@lru_cache(1)
def draws() -> np.ndarray:
    """Of each slot of draws, for each sample: 1 / r, beta, r and log c + r (beta - 1), with r and c drawn from Gamma(2, 1) and beta uniform, from a fixed seed."""
    rng, shape = np.random.default_rng(20), (DRAWS, BANDS * ROWS)
    r, log_c, beta = rng.gamma(2, 1, shape).astype(np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, np.float32)
    return np.stack([1 / r, beta, r, log_c + r * (beta - 1)], 1)


def _lists(column: pa.Array):
    """Values of each list, without copies."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _parts(batches, rows: int = 256):
    """Slices of the batches: a worker holds the texts of a few rows at a time as Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def idf_table(texts: DataFrame, n_docs: int) -> np.ndarray:
    """Weight of each slot; SLOTS values whatever the corpus."""

    def count(batches):
        held = np.zeros(SLOTS, np.int64)
        for batch in _parts(batches):
            for own in all_shingles(_texts(batch)):
                held[np.unique(own & (SLOTS - 1))] += 1
        at = np.flatnonzero(held)
        for first in range(0, len(at), 1 << 16):
            part = at[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], ["slot", "n"])

    counts = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # Slots with one document need no row: one is the least count that any looked-up slot has.
    found = counts.filter("n > 1").toArrow()
    seen = np.ones(SLOTS)
    seen[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return (1 - (1 - MIN_IDF) * np.log(seen) / max(np.log(max(n_docs, 2)), 1e-9)).clip(MIN_IDF, 1).astype(np.float32)


def weighted(own: np.ndarray, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, their weights 1 + ln(count), and these times their inverse document frequencies (1 if none are given)."""
    ids, counts = np.unique(own, return_counts=True)
    plain = 1 + np.log(counts)
    return ids, plain, plain if idf is None else plain * idf[ids & (SLOTS - 1)]


def samples(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hashes of the BANDS bands of a weighted set: of each sample the shingle of least log(a), and the step of its weight."""
    table, best = draws(), None
    k = np.arange(BANDS * ROWS)
    for first in range(0, len(ids), 256):
        part = ids[first : first + 256]
        own = table[(part >> 20) & (DRAWS - 1)]
        t = own[:, 0] * np.log(weights[first : first + 256]).astype(np.float32)[:, None]
        t += own[:, 1]
        np.floor(t, out=t)
        a = own[:, 2] * t
        np.subtract(own[:, 3], a, out=a)
        at = a.argmin(0)
        low, own_id, step = a[at, k], part[at], t[at, k].astype(np.int64)
        if best is None:
            best, pick, steps = low, own_id, step
        else:
            less = low < best
            best, pick, steps = np.where(less, low, best), np.where(less, own_id, pick), np.where(less, step, steps)
    with np.errstate(over="ignore"):
        h = (pick * np.int64(-7046029254386353131)) ^ (steps * np.int64(0x2545F4914F6CDD1D))
        h ^= h >> np.int64(29)
        out = np.zeros(BANDS, np.int64)
        for column in h.reshape(BANDS, ROWS).T:
            out = (out ^ column) * np.int64(-4417276706812531889)
            out ^= out >> np.int64(31)
    return out


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two weighted sets: the greater of those under their two weightings."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    best = 0.0
    for x, y in zip(a[1:], b[1:], strict=True):
        least = np.minimum(x[i], y[j]).sum()
        whole = x.sum() + y.sum() - least
        best = max(best, float(least / whole) if whole else 1.0)
    return best


def bands(texts: DataFrame, idf) -> DataFrame:
    """key, band (its number is part of the hash)."""

    def run(batches):
        salt = np.arange(BANDS, dtype=np.int64) * np.int64(0x9E3779B97F4A7C1)
        for batch in _parts(batches):
            keys, found, texts = [], [], _texts(batch)
            for text, own in zip(texts, all_shingles(texts), strict=True):
                if len(own):
                    ids, _, weights = weighted(own, idf.value)
                    keys.append(text_key(text))
                    found.append(samples(ids, weights) + salt)
            if found:
                keys = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found))], ["key", "band"])

    return texts.mapInArrow(run, "key binary, band long")


def sets(texts: DataFrame) -> DataFrame:
    """key, shingles of texts (key, text)."""

    def run(batches):
        for part in _parts(batches):
            found = list(all_shingles(_texts(part)))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))], ["key", "shingles"])

    return texts.select("key", "text").mapInArrow(run, "key binary, shingles array<bigint>")


def _both(pairs: DataFrame, hashed: DataFrame) -> DataFrame:
    """The pairs with the shingles of a (sa) and b (sb).

    The side with few distinct ids (b, a bucket's hub) may be asked for very often, so pairs are first
    joined to a's shingles, and then to b's, whose hot ids adaptive execution splits.
    """
    return pairs.join(hashed.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(hashed.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")


def verified(pairs: DataFrame, hashed: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) with their similarity."""

    def run(batches):
        for batch in batches:
            last, held = None, None
            sims = []
            for b, x, y in zip(batch.column("b").to_pylist(), _lists(batch.column("sa")), _lists(batch.column("sb")), strict=True):
                if b != last:
                    last, held = b, weighted(y, idf.value)
                sims.append(similarity(weighted(x, idf.value), held))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return _both(pairs, hashed).select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, similarity double")


def centres(members: DataFrame, hashed: DataFrame) -> DataFrame:
    """For each hub (b) of members (a, b) a set in the middle of them: ids, weights of the shingles that most of about SAMPLE
    members have. It is a pivot: what is found around it is exact wherever it lies."""
    counts = members.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    sample = members.join(counts, "b").filter(F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / SAMPLE)) == 0)
    texts = sample.select("b", "a").join(hashed.select(F.col("key").alias("a"), "shingles"), "a").select("b", "shingles")

    def middle(group: pa.Table) -> pa.Table:
        sets_ = [weighted(x) for x in _lists(group.column("shingles").combine_chunks())]
        ids, at = np.unique(np.concatenate([x[0] for x in sets_]), return_inverse=True)
        weights, n = np.bincount(at, np.concatenate([x[1] for x in sets_]), len(ids)), np.bincount(at, minlength=len(ids))
        most = 2 * n > len(sets_)
        return pa.table({"b": group.column("b").slice(0, 1), "ids": pa.array([ids[most]], pa.list_(pa.int64())), "weights": pa.array([(weights / np.maximum(n, 1))[most]], pa.list_(pa.float64()))})

    return texts.groupBy("b").applyInArrow(middle, "b binary, ids array<bigint>, weights array<double>")


def differences(own: tuple, centre: tuple) -> tuple[np.ndarray, list]:
    """What sets a weighted set apart from a centre: elements in a fixed order (those the centre lacks first, then by hash),
    and for each weighting the weights of the difference from each element on, and the distance less SLACK of the set's size.
    Left out are elements from which on the difference is too small for any set alike to this one."""
    ids = np.union1d(own[0], centre[0])
    in_own, in_centre = np.searchsorted(ids, own[0]), np.searchsorted(ids, centre[0])
    novel = np.ones(len(ids), bool)
    novel[in_centre] = False
    order = np.lexsort((ids, ~novel))
    found, keep = [], np.zeros(len(ids), bool)
    for x, y in zip(own[1:], centre[1:], strict=True):
        gap = np.zeros(len(ids))
        gap[in_own] += x
        gap[in_centre] -= y
        gap = np.abs(gap)[order]
        rest, size = gap[::-1].cumsum()[::-1], x.sum()
        # One alike has at most size / THRESHOLD, and lies from the centre no nearer than this one less SLACK of both sizes.
        keep |= (gap > 1e-9) & (rest >= gap.sum() - SLACK * size * (1 + 1 / THRESHOLD) - 1e-6)
        found.append((rest, gap.sum() - SLACK * size))
    return ids[order][keep], [(rest[keep], excess) for rest, excess in found]


def around(members: DataFrame, hashed: DataFrame, idf) -> DataFrame:
    """The members (a, b: a hub of its bucket, label) by what sets them apart from their hub's centre: key, hub, label, excess
    (e_p, e_q, by weighting), and a row for each element (with what is left of the difference from it on) and one without."""
    names = ["rest_p", "rest_q", "e_p", "e_q"]

    def run(batches):
        for batch in _parts(batches, 64):
            picks, elements, numbers = [], [], [[] for _ in names]
            last, held = None, None
            for k, (b, own, ids, weights) in enumerate(zip(batch.column("b").to_pylist(), *map(_lists, (batch.column("sa"), batch.column("ids"), batch.column("weights"))), strict=True)):
                if b != last:
                    last, held = b, (ids, weights, weights * idf.value[ids & (SLOTS - 1)])
                found, (p, q) = differences(weighted(own, idf.value), held)
                n = len(found) + 1
                picks.append(np.full(n, k))
                elements.append(np.append(found, 0))
                for into, value in zip(numbers, (np.append(p[0], -1), np.append(q[0], -1), np.full(n, p[1]), np.full(n, q[1])), strict=True):
                    into.append(value)
            if elements:
                at, numbers = pa.array(np.concatenate(picks)), [np.concatenate(x) for x in numbers]
                element = pa.array(np.concatenate(elements), mask=numbers[0] < 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("a", "b", "label")), element, *(pa.array(x.astype(np.float32)) for x in numbers)], ["key", "hub", "label", "element", *names])

    both = members.join(hashed.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(centres(members, hashed), "b")
    schema = "key binary, hub binary, label binary, element long, " + ", ".join(f"{n} float" for n in names)
    return staged(both.select("a", "b", "label", "sa", "ids", "weights").mapInArrow(run, schema), "differences")


def nearest(rows: DataFrame) -> DataFrame:
    """hub, and for each weighting its member nearest to the centre (n_p, n_q), its class (l_p, l_q) and its excess (m_p, m_q)."""
    least = lambda w: F.min(F.struct(f"e_{w}", "key", "label"))
    found = rows.filter("element is null").groupBy("hub").agg(least("p").alias("p"), least("q").alias("q"))
    return found.select("hub", *[F.col(f"{w}.{c}").alias(f"{n}_{w}") for w in "pq" for c, n in (("key", "n"), ("label", "l"), (f"e_{w}", "m"))])


def nearest_pairs(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Of rows (see `around`) and their nearest ones (see `nearest`): each member with its hub's nearest ones of other classes. If the excesses of two sum to 0 or less, both are alike to the nearest:
    a distance is at most the sum of those from the centre, and two are alike where it is at most SLACK of their sizes."""
    own = rows.filter("element is null").join(small_side(least), "hub")
    each = F.explode(F.array(*[F.struct(F.col(f"n_{w}").alias("b"), F.col(f"l_{w}").alias("lb")) for w in "pq"])).alias("x")
    return own.select(F.col("key").alias("a"), "label", each).filter("label != x.lb").select("a", F.col("x.b").alias("b")).distinct()


def apart(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one hub and different classes that may be alike though their excesses sum to more than 0.

    All that are alike are among them: their distance falls short of the sum of those from the centre by what they share of
    their differences from it, so they share at least half the sum of their excesses. Elements of the differences are joined
    in a fixed order: from the first common one on, what is left of both must reach that. What all members of a group share is
    in no difference, so a group's size doesn't enter.
    """
    enough = F.lit(False)
    for w in "pq":
        enough = enough | (F.col(f"rest_{w}") >= (F.col(f"e_{w}") + F.col(f"m_{w}")) / 2 - 1e-3)
    rows = rows.filter("element is not null").join(small_side(least.select("hub", "m_p", "m_q")), "hub").filter(enough)
    # Of the members that share an element those of its most frequent class need not meet each other.
    kinds = rows.groupBy("hub", "element", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("hub", "element")
    kinds = kinds.agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("hub", "element", "top")
    left = rows.join(kinds, ["hub", "element"]).filter("label != top").drop("top").alias("x")
    right = rows.alias("m")
    reaches = F.lit(False)
    for w in "pq":
        reaches = reaches | (F.least(f"x.rest_{w}", f"m.rest_{w}") >= (F.col(f"x.e_{w}") + F.col(f"m.e_{w}")) / 2 - 1e-3)
    met = left.join(right, (F.col("x.hub") == F.col("m.hub")) & (F.col("x.element") == F.col("m.element")) & (F.col("x.label") != F.col("m.label")) & reaches)
    return met.select(F.greatest("x.key", "m.key").alias("a"), F.least("x.key", "m.key").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """key, label: the least key linked to it, for keys with edges (a > b); alternating star operations.

    Each round hangs every neighbour on the least one around it; rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder.
    """
    current, size = staged(edges.select("a", "b").distinct(), "edges"), None
    while True:
        # Large star: greater neighbours hang on the least of a key's neighbours and itself.
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        # Small star: lesser neighbours and the key itself hang on the least of them.
        large = large.distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(small_least, "a")
        small = both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(both.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        after = staged(small, "edges")
        stats = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(stats) == size:
            return after.select(F.col("a").alias("key"), F.col("b").alias("label"))
        current, size = after, tuple(stats)


def placed(docs: DataFrame, key: str = "doc_id", place: tuple[str, str] | None = None) -> DataFrame:
    """One row for every row of docs (place: the columns of located(), if it has them): row_key, at_file, at_row, label (the class), n_links, copies."""
    spark = docs.sparkSession
    docs, *place = (docs, *place) if place else located(docs)
    own = docs.select(F.col(key).cast("long").alias("row_key"), F.col(place[0]).alias("at_file"), F.col(place[1]).alias("at_row"), text_of().cast("binary").alias("text"))

    def name(batches):
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "at_file", "at_row")), pa.array(map(text_key, _texts(batch)), pa.binary())], ["row_key", "at_file", "at_row", "key"])

    rows = staged(own.mapInArrow(name, "row_key long, at_file string, at_row long, key binary"), "rows")
    texts_of = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("at_file", "at_row")).alias("first")), "members")
    # Shingles are never stored for all texts: each pass makes them again, without the texts that are copies.
    copies = rows.join(texts_of.filter("copies > 1"), "key").filter(F.struct("at_file", "at_row") != F.col("first")).select("at_file", "at_row")
    texts = own.join(small_side(copies), ["at_file", "at_row"], "left_anti").select("text")
    idf = spark.sparkContext.broadcast(idf_table(texts, texts_of.count()))

    banded = staged(bands(texts, idf), "bands")
    # The first hub of a bucket is drawn by a hash, so the bands of a large group have many different hubs.
    heads = banded.groupBy("band").agg(F.min_by("key", F.xxhash64("key", "band")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub")
    shared = staged(banded.join(heads, "band").withColumn("past", F.array("hub")), "buckets")
    # Only texts that share a band with another are read for verification, once.
    wanted = texts_of.join(shared.select("key").distinct(), "key", "left_semi").select("first.at_file", "first.at_row", "key")
    hashed = staged(sets(own.join(small_side(wanted), ["at_file", "at_row"])), "sets")

    tried = staged(verified(shared.filter("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct(), hashed, idf), "verified")
    linked = lambda pairs: pairs.filter(F.col("similarity") >= THRESHOLD - 1e-12).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = linked(tried)
    labels = components(edges)
    relabelled = lambda df: df.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    for turn in range(HUBS + 2):
        if turn <= HUBS:
            # Buckets of several classes still hold pairs that nobody tried.
            named = relabelled(shared)
            mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
            shared = staged(named.join(mixed, "band", "left_semi"), "several")
        if turn < HUBS:
            # The next hub is the member most like the last one: it lies nearer to the middle of a group. Similarities
            # are those of all turns; a bucket without any takes another member, and none leaves before its pairs are tried.
            known = tried.select(F.col("a").alias("key"), F.col("b").alias("hub"), "similarity")
            known = known.unionByName(tried.select(F.col("b").alias("key"), F.col("a").alias("hub"), "similarity")).groupBy("key", "hub").agg(F.max("similarity").alias("similarity"))
            near_hub = shared.withColumn("new", ~F.array_contains("past", F.col("key"))).join(known, ["key", "hub"], "left")
            rank = F.struct("new", F.coalesce("similarity", F.lit(-1.0)), F.xxhash64("key", "band"))
            hubs = near_hub.groupBy("band").agg(F.max_by(F.struct(F.col("key").alias("hub"), F.col("label").alias("hub_label")), rank).alias("h")).select("band", "h.*")
            shared = shared.drop("hub").join(hubs, "band").withColumn("past", F.array_union("past", F.array("hub")))
            shared = staged(shared, "buckets")
            pairs = shared.filter("key != hub and label != hub_label").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
            shared = shared.drop("hub_label", "label")
        elif turn == HUBS:
            # What is left is searched around the middle of its buckets, named by the member that stands in most of them, so that they share it.
            wide = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n_buckets"))
            hubs = shared.join(wide, "key").groupBy("band").agg(F.max_by("key", F.struct("n_buckets", "key")).alias("hub"))
            members = staged(shared.drop("hub").join(hubs, "band").select(F.col("key").alias("a"), F.col("hub").alias("b"), "label").distinct(), "left")
            if members.isEmpty():
                break
            rows_around = around(members, hashed, idf)
            least = staged(nearest(rows_around), "nearest")
            pairs = nearest_pairs(rows_around, least)
        else:
            pairs = apart(relabelled(rows_around.drop("label")), least)
        known = tried.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        pairs = pairs.join(known, (F.greatest("a", "b") == F.col("high")) & (F.least("a", "b") == F.col("low")), "left_anti")
        latest = staged(verified(pairs, hashed, idf), "verified")
        if latest.isEmpty():
            continue
        tried, more = tried.unionByName(latest), linked(latest)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    known = texts_of.join(labels, "key", "left").join(degree, "key", "left").withColumn("label", F.coalesce("label", "key"))
    return staged(rows.join(known, "key").select("row_key", "at_file", "at_row", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"), "classes")


def classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for every row of docs: key, class_id (the least key of the class), n_links (verified links of its text
    to other texts, of those tried), copies (rows with the same words)."""
    found = placed(docs, key)
    least = found.groupBy("label").agg(F.min("row_key").alias("class_id"))
    return found.join(least, "label").select(F.col("row_key").alias(key), "class_id", "n_links", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one of least doc_id (rows without an id last; equal ids go by place in the files)."""
    own, file, row = located(docs)
    found = placed(own, place=(file, row))
    mine = F.struct(F.col("row_key").isNull(), "row_key", "at_file", "at_row")
    first = found.groupBy("label").agg(F.min(mine).alias("first"))
    gone = found.join(first, "label").filter(~mine.eqNullSafe(F.col("first"))).select(F.col("at_file").alias(file), F.col("at_row").alias(row))
    return own.join(small_side(gone), [file, row], "left_anti").select(*docs.columns)
