"""Source divergence audit over a vocabulary held in minimal acyclic transducers.

Terms are runs of letters and of characters beyond ASCII, A to Z in lower case. Each language keeps the terms of at least
MIN_DOCS of its documents. The kept terms, in order, are built into transducers of bounded size (at most SHARD_TERMS
terms and SHARD_BYTES bytes each; a state is shared by all that may follow alike); the numbers on the arcs passed add up
to a term's ordinal in its language, and text without the term falls out. All texts then stream through the
transducers of their language, all terms of a chunk side by side, which counts each term by source; ordinals order
equal values as their terms would be ordered.

While the transducers together have at most BROADCAST_BYTES they are sent to every task, else terms are sent to them:
occurrences, summed by task, go to the partitions of their range of terms, several for each, and stream through there.

How far two sources differ is summed over all kept terms as sources by sources, a block of a row of sources at a time; a
language's sources are bounded by the result, which has a row for each pair of them.

Defined results: a null text, lang or source counts as empty; very long texts and terms are read in whole; repeated rows are
documents of their own; a source without kept terms still has its rows; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.base import small_side, staged

MIN_DOCS, TOP = 3, 200
SHARD_TERMS, SHARD_BYTES = 1 << 16, 1 << 21
BROADCAST_BYTES = 1 << 26
#: Partitions of each range of terms where terms are sent to the transducers.
SALTS = 8
#: Entries that a task holds before it sends them on, and characters read at once.
HELD, CHUNK = 1 << 18, 1 << 20
#: Sums that a task holds for pairs of sources.
PAIRS = 1 << 22
ONE = 1_000_000_000
#: Every byte as it counts: letters in lower case, bytes of other characters, and blanks for all the rest.
FOLD = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def own_columns(docs: DataFrame) -> DataFrame:
    """lang, source, text, nulls as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


class Transducer:
    """Arcs in an open hash table: key state * 256 + byte, value the next state and what the arc adds to the ordinal."""

    def __init__(self, n: int, arcs: np.ndarray, final: np.ndarray):
        self.n, self.final = n, final
        self.bits = max(4, int(2 * len(arcs)).bit_length())
        self.keys, self.next, self.add = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(arcs)), self._slot(arcs[:, 0]) if len(arcs) else np.zeros(0, np.int64)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            won = first[free[first]]
            self.keys[slot[won]], self.next[slot[won]], self.add[slot[won]] = arcs[todo[won], 0], arcs[todo[won], 1], arcs[todo[won], 2]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], slot[left]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & (len(self.keys) - 1), slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def of(cls, terms: list[bytes]) -> Transducer:
        """Of sorted distinct terms, state by state: what can't change any more is shared with an equal state."""
        known: dict[tuple, int] = {}
        counts: list[int] = []
        arcs: list[tuple[int, int, int]] = []
        finals: list[bool] = []
        path: list[list] = [[False, []]]  # states of the last term that may still grow: final, arcs (byte, state)

        def close(state: list) -> int:
            shape = (state[0], *state[1])
            found = known.get(shape)
            if found is None:
                known[shape] = found = len(finals) + 1
                finals.append(state[0])
                upto = int(state[0])
                for byte, to in state[1]:
                    arcs.append((found << 8 | byte, to, upto))
                    upto += counts[to - 1]
                counts.append(upto)
            return found

        def shorten(length: int) -> None:
            while len(path) > length + 1:
                done = close(path.pop())
                path[-1][1].append((last[len(path) - 1], done))

        last = b""
        for term in terms:
            same = 0
            most = min(len(last), len(term))
            while same < most and last[same] == term[same]:
                same += 1
            shorten(same)
            path += [[False, []] for _ in range(len(term) - same)]
            path[-1][0] = True
            last = term
        shorten(0)
        root = close(path[0])
        whole = np.array(arcs, np.int64).reshape(-1, 3)
        # The root is state 0: it has no equal, since nothing leads back to it.
        whole[whole[:, 0] >> 8 == root, 0] &= 255
        return cls(len(terms), whole, np.array([finals[root - 1], *finals], np.uint8))

    def dump(self) -> bytes:
        used = np.flatnonzero(self.keys >= 0)
        parts = (self.keys[used].astype("<i8"), self.next[used].astype("<i4"), self.add[used].astype("<i4"), self.final)
        return struct.pack("<qqq", self.n, len(used), len(self.final)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        n, m, states = struct.unpack("<qqq", data[:24])
        keys, to, add = np.frombuffer(data, "<i8", m, 24), np.frombuffer(data, "<i4", m, 24 + 8 * m), np.frombuffer(data, "<i4", m, 24 + 12 * m)
        return cls(n, np.stack([keys, to, add], 1), np.frombuffer(data, np.uint8, states, 24 + 16 * m))

    def ordinals(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ordinal of the term that begins at each start and ends before a blank; -1 if it isn't in the vocabulary."""
        out = np.full(len(starts), -1, np.int64)
        alive, at, state, total = np.arange(len(starts)), starts, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        mask = len(self.keys) - 1
        while len(alive):
            byte = data[at]
            ended = byte == 32
            if ended.any():
                over = np.flatnonzero(ended)
                out[alive[over]] = np.where(self.final[state[over]] > 0, total[over], -1)
                rest = np.flatnonzero(~ended)
                alive, at, state, total, byte = alive[rest], at[rest], state[rest], total[rest], byte[rest]
            key = state << 8 | byte
            slot = self._slot(key)
            found = self.keys[slot]
            off = np.flatnonzero((found != key) & (found >= 0))
            while len(off):
                slot[off] = (slot[off] + 1) & mask
                seen = self.keys[slot[off]]
                found[off] = seen
                off = off[(seen != key[off]) & (seen >= 0)]
            go = np.flatnonzero(found == key)
            slot = slot[go]
            alive, at, state, total = alive[go], at[go] + 1, self.next[slot].astype(np.int64), total[go] + self.add[slot]
        return out


def folded(text: str) -> bytes:
    return text.encode().translate(FOLD)


def pieces(data: bytes):
    """Folded text in pieces of about CHUNK bytes, cut at blanks."""
    first = 0
    while len(data) - first > CHUNK:
        cut = data.rfind(b" ", first, first + CHUNK)
        if cut <= first and (cut := data.find(b" ", first + CHUNK)) < 0:
            break
        yield data[first:cut]
        first = cut
    yield data[first:]


def starts_of(data: np.ndarray) -> np.ndarray:
    """Where terms begin in folded text."""
    letter = data != 32
    return np.flatnonzero(letter & ~np.append(False, letter[:-1]))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_counts(own: DataFrame) -> DataFrame:
    """lang, term, n_docs (of a task's documents; several rows a term)."""

    def run(batches):
        seen: dict[tuple[str, bytes], int] = {}

        def flush():
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), _strings([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["lang", "term", "n_docs"])
                seen.clear()

        for batch in batches:
            langs = batch.column("lang")
            for k, text in enumerate(batch.column("text")):
                lang, terms = langs[k].as_py(), set()
                for piece in pieces(folded(text.as_py())):
                    terms.update(piece.split())
                for term in terms:
                    seen[lang, term] = seen.get((lang, term), 0) + 1
                if len(seen) > HELD:
                    yield from flush()
        yield from flush()

    return own.select("lang", "text").mapInArrow(run, "lang string, term string, n_docs bigint")


def vocabulary(own: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Stored rows of two kinds: terms (lang, shard, place in it, term) and transducers (lang, shard, first term, n, machine)."""
    terms = document_counts(own).groupBy("lang", "term").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")
    terms = staged(terms, "terms")
    n = max(1, -(-terms.count() // shard_terms))

    def run(batches):
        from pyspark import TaskContext

        task, number, lang, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def flush():
            nonlocal number, held, size
            if held:
                shard = task << 32 | number
                names = _strings(held)
                m = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([shard] * m, pa.int64()), pa.array(range(m), pa.int64()), names, pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], NAMES)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([shard], pa.int64()), pa.nulls(1, pa.int64()), names[:1], pa.array([m], pa.int64()), pa.array([Transducer.of(held).dump()], pa.binary())], NAMES)
                number, held, size = number + 1, [], 0

        for batch in batches:
            for own_lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist(), strict=True):
                if own_lang != lang or len(held) >= shard_terms or size > SHARD_BYTES:
                    yield from flush()
                    lang = own_lang
                held.append(term)
                size += len(term)
        yield from flush()

    ordered = terms.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    return staged(ordered.mapInArrow(run, VOCABULARY), "vocabulary")


VOCABULARY = "lang string, shard bigint, place bigint, term string, n bigint, machine binary"
NAMES = [c.split()[0] for c in VOCABULARY.split(", ")]
COUNTED = "lang string, source string, ordinal bigint, n bigint"


def summed(names: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names and the sum of n of each."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    firsts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[firsts], np.add.reduceat(n[order], firsts)


class Tally:
    """Counts by (lang, source) and ordinal, sent on when there are HELD of them."""

    def __init__(self):
        self.held, self.size = {}, 0

    def add(self, lang: str, source: str, ordinals: np.ndarray, n: np.ndarray | None = None):
        if len(ordinals):
            self.held.setdefault((lang, source), []).append(summed(ordinals, np.ones(len(ordinals), np.int64) if n is None else n))
            self.size += len(self.held[lang, source][-1][0])

    def batches(self, least: int = HELD):
        if self.size >= max(least, 1):
            kept = {}
            for key, parts in self.held.items():
                kept[key] = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
            self.held, self.size = kept, sum(len(p[0][0]) for p in kept.values())
            if self.size >= max(least // 2, 1):
                for (lang, source), ((names, out),) in self.held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names), pa.array(out)], ["lang", "source", "ordinal", "n"])
                self.held, self.size = {}, 0


def shards_of(words: DataFrame) -> DataFrame:
    """lang, shard, term (its first), n, before (terms of the language in earlier shards)."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.filter("machine is not null").select("lang", "shard", "term", "n", before.alias("before"))


def recounted(own: DataFrame, words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, ordinal, n: occurrences of kept terms, by streaming all texts through the transducers."""
    machines = words.filter("machine is not null").select("shard", "machine")
    size = machines.agg(F.sum(F.octet_length("machine"))).first()[0] or 0
    shards = shards_of(words)
    rows = _with_texts(own, shards.join(machines, "shard")) if size <= broadcast_bytes else _with_terms(own, shards, machines)
    return rows.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _with_texts(own: DataFrame, shards: DataFrame) -> DataFrame:
    sent: dict[str, list[tuple[int, bytes]]] = {}
    for r in shards.collect():  # at most broadcast_bytes
        sent.setdefault(r["lang"], []).append((r["before"], bytes(r["machine"])))
    box = own.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        loaded: dict[str, list[tuple[int, Transducer]]] = {}
        tally = Tally()

        def read(lang: str, source: str, data: bytes) -> None:
            if lang not in loaded:
                loaded[lang] = [(before, Transducer.load(m)) for before, m in box.value.get(lang, [])]
            for piece in pieces(data):
                text = np.frombuffer(piece + b" ", np.uint8)
                starts = starts_of(text)
                for before, machine in loaded[lang]:
                    found = machine.ordinals(text, starts)
                    hit = found >= 0
                    tally.add(lang, source, found[hit] + before)
                    starts = starts[~hit]

        for batch in batches:
            waiting: dict[tuple[str, str], list[bytes]] = {}
            size = 0
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for k, text in enumerate(batch.column("text")):
                data = folded(text.as_py())
                waiting.setdefault((langs[k], sources[k]), []).append(data)
                size += len(data)
                if size > 4 * CHUNK:
                    for key, parts in waiting.items():
                        read(*key, b" ".join(parts))
                    waiting, size = {}, 0
            for key, parts in waiting.items():
                read(*key, b" ".join(parts))
            yield from tally.batches()
        yield from tally.batches(0)

    return own.mapInArrow(run, COUNTED)


def _with_terms(own: DataFrame, shards: DataFrame, machines: DataFrame) -> DataFrame:
    """The same where there are too many transducers for every task."""
    bounds = sorted((r["lang"], r["term"].encode(), r["shard"], r["before"]) for r in shards.collect())  # one row for SHARD_TERMS terms
    box = own.sparkSession.sparkContext.broadcast(([b[:2] for b in bounds], bounds))

    def route(batches):
        firsts, rows = box.value
        seen: dict[tuple[str, str, bytes], int] = {}

        def flush():
            out = []
            for (lang, source, term), n in seen.items():
                k = bisect_right(firsts, (lang, term)) - 1
                if k >= 0 and rows[k][0] == lang:
                    out.append((rows[k][2], rows[k][3], lang, source, term, n))
            if out:
                shard, before, lang, source, term, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(before, pa.int64()), pa.array(lang, pa.string()), pa.array(source, pa.string()), _strings(list(term)), pa.array(n, pa.int64())], ["shard", "before", "lang", "source", "term", "n"])
            seen.clear()

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for k, text in enumerate(batch.column("text")):
                lang, source = langs[k], sources[k]
                for piece in pieces(folded(text.as_py())):
                    for term in piece.split():
                        key = (lang, source, term)
                        seen[key] = seen.get(key, 0) + 1
                    if len(seen) > HELD:
                        yield from flush()
        yield from flush()

    def run(batches):
        tally, machine = Tally(), None
        for batch in batches:
            bodies = batch.column("machine")
            at = [k for k in range(batch.num_rows) if bodies[k].is_valid] + [batch.num_rows]
            for first, last in zip([-1, *at], at, strict=False):
                if first >= 0:
                    machine = Transducer.load(bodies[first].as_py())
                part = batch.slice(first + 1, last - first - 1)
                if part.num_rows:
                    terms = part.column("term").cast(pa.binary()).to_pylist()
                    text = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
                    found = machine.ordinals(text, starts_of(text))
                    keys, n, before = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)), part.column("n").to_numpy(), part.column("before").to_numpy()
                    names, where = {key: i for i, key in enumerate(dict.fromkeys(keys))}, None
                    where = np.array([names[key] for key in keys])
                    for key, i in names.items():
                        mine = np.flatnonzero((where == i) & (found >= 0))
                        tally.add(*key, found[mine] + before[mine], n[mine])
            yield from tally.batches()
        yield from tally.batches(0)

    routed = own.mapInArrow(route, "shard bigint, before bigint, lang string, source string, term string, n bigint").withColumn("salt", F.pmod(F.xxhash64("term", "source"), F.lit(SALTS)).cast("int")).withColumn("machine", F.lit(None).cast("binary"))
    copies = machines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = routed.unionByName(copies, allowMissingColumns=True)
    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("machine").isNull()).mapInArrow(run, COUNTED)


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(ONE * (n + 1) / (total + size)), exact for any counts of 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.floor(F.call_function("div", (wide(n) + 1) * F.lit(ONE).cast("decimal(10,0)"), wide(total) + wide(size)))).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(own: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """Every occurring (lang, source): its number among the language's sources, total, the language's total and size, zero (the share of a term without occurrences)."""
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = words.filter("machine is not null").groupBy("lang").agg(F.sum("n").alias("size"))
    found = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size"])
    w = Window.partitionBy("lang")
    found = found.withColumns({"sid": (F.row_number().over(w.orderBy("source")) - 1).cast("int"), "n_sources": F.count(F.lit(1)).over(w).cast("int"), "lang_total": F.sum("total").over(w)})
    return found.withColumn("zero", F.when(F.col("size") > 0, share(F.lit(0), F.col("total"), F.col("size"))))


def shares(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a kept term: lang, ordinal, q (the language's share), each (sid, p of the sources that have it)."""
    narrow = groups.select("lang", "source", "sid", "total", "size", "lang_total")
    own = counts.join(small_side(narrow), ["lang", "source"])
    own = own.select("lang", "ordinal", "n", "size", "lang_total", F.struct("sid", share(F.col("n"), F.col("total"), F.col("size")).alias("p")).alias("x"))
    rows = own.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("lang_total").alias("lang_total"), F.collect_list("x").alias("each"))  # a source once
    return rows.select("lang", "ordinal", share(F.col("n"), F.col("lang_total"), F.col("size")).alias("q"), "each")


def pair_sums(terms: DataFrame, groups: DataFrame, most: int = PAIRS) -> DataFrame:
    """lang, a, b, value: the distance of source a from source b, summed over all kept terms, for every two sources of a language with kept terms."""
    zeros: dict[str, np.ndarray] = {}
    for r in groups.filter("size > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("sid", "zero"))).alias("x")).collect():  # as many as a source has rows in the result
        zeros[r["lang"]] = np.array([x["zero"] for x in r["x"]], np.int64)
    box = terms.sparkSession.sparkContext.broadcast(zeros)

    def run(batches):
        held, sums = (None, None), None

        def flush():
            if sums is not None:
                lang, block = held
                n = len(box.value[lang])
                a, b = np.divmod(np.arange(sums.size), n)
                a += block * height(n, most)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * sums.size, pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums.ravel())], ["lang", "a", "b", "value"])

        for batch in batches:
            langs, blocks, each = batch.column("lang").to_pylist(), batch.column("block").to_numpy(), batch.column("each")
            sizes = np.diff(each.offsets.to_numpy())
            flat = each.flatten()
            sid, p = flat.field("sid").to_numpy(), flat.field("p").to_numpy()
            ends = np.cumsum(sizes)
            first = 0
            while first < len(langs):
                key = (langs[first], int(blocks[first]))
                zero = box.value[key[0]]
                n = len(zero)
                last = first
                while last < len(langs) and last - first < max(1, most // n // 8) and (langs[last], int(blocks[last])) == key:
                    last += 1
                if key != held:
                    yield from flush()
                    held, sums = key, np.zeros((min(height(n, most), n - key[1] * height(n, most)), n), np.int64)
                begin = ends[first] - sizes[first]
                whole = np.repeat(zero[None, :], last - first, 0)
                whole[np.repeat(np.arange(last - first), sizes[first:last]), sid[begin : ends[last - 1]]] = p[begin : ends[last - 1]]
                for i in range(len(sums)):
                    diff = whole[:, [key[1] * height(n, most) + i]] - whole
                    sums[i] += (diff * diff // whole).sum(0)
                first = last
        yield from flush()

    n_blocks = F.ceil(F.col("n_sources") / F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n_sources")))).cast("int")
    blocks = groups.filter("size > 0").select("lang", "n_sources").distinct().select("lang", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    rows = terms.join(small_side(blocks), "lang").select("lang", "block", "each").sortWithinPartitions("lang", "block")
    parts = rows.mapInArrow(run, "lang string, a int, b int, value bigint").filter("a != b")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def height(n: int, most: int = PAIRS) -> int:
    """Sources whose sums against all n a task holds at once."""
    return min(n, max(1, most // n))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, broadcast_bytes: int = BROADCAST_BYTES, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank."""
    own = own_columns(docs)
    words = vocabulary(own, min_docs, shard_terms)
    counts = staged(recounted(own, words, broadcast_bytes), "counts")
    groups = staged(groups_of(own, words, counts), "groups")
    terms = staged(shares(counts, groups), "shares")
    # Distances of sources; those of a language without kept terms are 0.
    names = groups.select("lang", "sid", "source")
    sums = pair_sums(terms, groups)
    bare = groups.filter("size = 0").select("lang", F.col("sid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_sources") - 1)).alias("b")).filter("a != b").withColumn("value", F.lit(0).cast("long"))
    side = lambda c, name: small_side(names.select("lang", F.col("sid").alias(c), F.col("source").alias(name)))
    pairs = sums.unionByName(bare).join(side("a", "source"), ["lang", "a"]).join(side("b", "item"), ["lang", "b"])
    pair_rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", pair_rank.alias("rank"))
    # Terms that a source has more often than its language; first the best of each part of a source, then of all.
    entries = terms.select("lang", "ordinal", "q", F.inline("each")).filter("p > q").select("lang", "sid", "ordinal", distance(F.col("p"), F.col("q")).alias("value"))
    by_value = lambda *keys: F.row_number().over(Window.partitionBy("lang", "sid", *keys).orderBy(F.desc("value"), "ordinal"))
    best = entries.withColumn("salt", F.pmod(F.xxhash64("ordinal"), F.lit(64))).withColumn("_k", by_value("salt")).filter(F.col("_k") <= top)
    best = best.withColumn("rank", by_value()).filter(F.col("rank") <= top)
    shards = small_side(shards_of(words).select("lang", "shard", "before"))
    spelt = words.filter("machine is null").join(shards, ["lang", "shard"]).select("lang", (F.col("before") + F.col("place")).alias("ordinal"), F.col("term").alias("item"))
    best = staged(best.select("lang", "sid", "ordinal", "value", "rank"), "best")
    found = spelt.join(small_side(best), ["lang", "ordinal"]).join(small_side(names), ["lang", "sid"])
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
