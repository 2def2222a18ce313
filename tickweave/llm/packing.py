"""Packing by a histogram of lengths: shortest pack first.

A document's ids, with an end id, are cut at every SIZE ids. The pieces' lengths are counted, and only that histogram of
at most SIZE rows is packed, on the driver: lengths go from the longest to the shortest, and each piece goes to the pack
that is filled least if it fits there, else to a new one. Packs of one filling are one pattern with a count, so the work
doesn't depend on how many documents there are. If more than MAX_PADDING stays open (many pieces of over half a sequence,
say), pieces are cut at every SIZE / 2 ids instead, then SIZE / 4, and so on.

A pattern's slots hold intervals of ranks: its k-th pack takes the k-th rank of each. Documents are joined back by rank
within their length: a running number within the task that encoded them, plus the number of such pieces in the tasks
before. Tasks note running crc32 values at every multiple of GRID, from which the checksum of any part follows, so no ids
are shuffled or stored.

Defined results: a null or empty text is its end id alone; very long texts are cut into many sequences; repeated rows and
equal or null doc_ids are packed each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.base import small_side, staged, text_of
from tickweave.llm.range_coder import CHARS_A_CHUNK, tokenise

SIZE, END_ID = 4096, 2
#: Cuts within a piece are at multiples of this many ids.
GRID = 16
#: Share of padding up to which pieces stay whole.
MAX_PADDING = 1 / 256
#: Pieces of one length are fewer than this power of two.
RANK_BITS = 40


class Pattern:
    """Packs filled alike. slots(): (length of the whole piece, first rank, start of the part, length of the part), in order.

    What was put in earlier is shared between patterns: a chain of (earlier, by how much its ranks are shifted here, new slots).
    """

    __slots__ = ("chain", "count", "fill", "shift")

    def __init__(self, count: int, fill: int = 0, chain: tuple | None = None, shift: int = 0):
        self.count, self.fill, self.chain, self.shift = count, fill, chain, shift

    def split(self, n: int) -> tuple[Pattern, Pattern]:
        """The first n packs, and the others."""
        return Pattern(n, self.fill, self.chain, self.shift), Pattern(self.count - n, self.fill, self.chain, self.shift + n)

    def with_slots(self, slots: list[tuple[int, int, int, int]]) -> Pattern:
        return Pattern(self.count, self.fill + sum(s[3] for s in slots), (self.chain, self.shift, slots))

    def slots(self) -> list[tuple[int, int, int, int]]:
        out, chain, shift = [], self.chain, self.shift
        while chain is not None:
            out += [(a, rank + shift, start, part) for a, rank, start, part in reversed(chain[2])]
            shift += chain[1]
            chain = chain[0]
        return out[::-1]


def shortest_first(parts: list[tuple[int, int, int, int]], size: int = SIZE) -> list[Pattern]:
    """Patterns of parts: (length of the part, length of the whole piece, start, how many)."""
    full, heap, serial = [], [], count()

    def keep(p: Pattern) -> None:
        if p.fill == size:
            full.append(p)
        elif p.count:
            heappush(heap, (p.fill, next(serial), p))

    for length, whole, start, n in sorted(parts, reverse=True):
        rank = 0
        while n:
            if heap and heap[0][0] + length <= size:
                p = heappop(heap)[2]
                roof = heap[0][0] if heap else size  # until the next pattern is the shortest
                each = min(max(1, (roof - p.fill) // length), (size - p.fill) // length, n // p.count)
                if not each:
                    p, rest = p.split(n)
                    keep(rest)
                    each = 1
            else:  # none has room: new packs, filled one after the other
                each = min(n, size // length)
                p = Pattern(n // each)
            keep(p.with_slots([(whole, rank + i * p.count, start, length) for i in range(each)]))
            rank, n = rank + each * p.count, n - each * p.count
    return full + [p for _, _, p in sorted(heap, key=lambda x: x[:2])]


def packed(histogram: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[Pattern]:
    """Patterns for a histogram of pieces: whole ones if that leaves little padding, else cut at every half, quarter, ... of size."""
    tokens, most = sum(length * n for length, n in histogram.items()), size
    while True:
        parts = [(min(most, length - start), length, start, n) for length, n in histogram.items() if length < size for start in range(0, length, most)]
        parts += [(size, size, 0, histogram[size])] if size in histogram else []
        found = shortest_first(parts, size)
        padding = sum(p.count for p in found) * size - tokens
        if padding < size or padding <= MAX_PADDING * tokens or most % 2 or most // 2 < grid or most // 2 % grid:
            return found
        most //= 2


class Places:
    """Where the part of a piece of some length that begins at some start stands, by the piece's rank."""

    def __init__(self, patterns: list[Pattern], size: int = SIZE):
        self.size, base, rows = size, 0, []
        for p in patterns:
            at = 0
            for length, rank, start, part in p.slots():
                rows.append((length * (size + 1) + start, rank, part, base, at))
                at += part
            base += p.count
        whole = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.codes, group = np.unique(whole[:, 0], return_inverse=True)
        self.keys, (self.rank, self.part, self.base, self.at) = (group.astype(np.int64) << RANK_BITS) + whole[:, 1], whole[:, 1:].T.copy()

    def of(self, length: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of the part, sequence and offset in it."""
        group = np.searchsorted(self.codes, length * (self.size + 1) + start)
        k = np.searchsorted(self.keys, (group << RANK_BITS) + rank, "right") - 1
        return self.part[k], self.base[k] + rank - self.rank[k], self.at[k]


def _shift_table() -> np.ndarray:
    """For each power of two of 32-bit numbers, what that many zero bytes make of each bit of a crc32 (as the polynomial has it)."""
    bits = np.array([(1 << j) >> 1 if j else 0xEDB88320 for j in range(32)], np.uint64)  # one zero bit
    apply = lambda table, x: np.bitwise_xor.reduce(np.where(x[:, None] >> np.arange(32, dtype=np.uint64) & np.uint64(1), table, np.uint64(0)), axis=1)
    out = []
    for doubled in range(5 + 31):
        if doubled >= 5:  # 32 zero bits and their doubles
            out.append(bits)
        bits = apply(bits, bits)
    return np.array(out)


SHIFTS = _shift_table()


def crc_of_rest(whole: np.ndarray, head: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """crc32 of what follows a head, from the crc32 of both together, of the head, and the number of ids that follow."""
    head = head.astype(np.uint64)
    for k, table in enumerate(SHIFTS):
        go = np.flatnonzero(n_ids >> k & 1)
        if len(go):
            bits = head[go, None] >> np.arange(32, dtype=np.uint64) & np.uint64(1)
            head[go] = np.bitwise_xor.reduce(np.where(bits, table, np.uint64(0)), axis=1)
    return (whole.astype(np.uint64) ^ head).astype(np.int64)


ENCODED = "doc_id bigint, task int, n_tokens bigint, first_full bigint, rest_rank bigint, crcs array<bigint>, marks binary"


def encoded(docs: DataFrame, tokeniser: str, size: int = SIZE, end_id: int = END_ID, grid: int = GRID) -> DataFrame:
    """A row for each row of docs: doc_id, task, n_tokens, the numbers within the task of its first whole piece and of its rest among those
    of equal length, crcs of its pieces, and marks: crc32 values of its rest's beginnings at multiples of grid."""
    schema = pa.schema([("doc_id", pa.int64()), ("task", pa.int32()), ("n_tokens", pa.int64()), ("first_full", pa.int64()), ("rest_rank", pa.int64()), ("crcs", pa.list_(pa.int64())), ("marks", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        task, full, seen = TaskContext.get().partitionId(), 0, np.zeros(size, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            first = 0
            while first < len(names):
                held, chars = [], 0
                while first + len(held) < len(names) and (not held or chars < CHARS_A_CHUNK):
                    held.append(texts[first + len(held)].as_py())
                    chars += len(held[-1])
                rows = []
                for name, ids in zip(names[first : first + len(held)], tokenise(held, tokeniser), strict=True):
                    ids = memoryview(ids + tail)
                    n = len(ids) // 4
                    rest = n % size
                    crcs = [zlib.crc32(ids[a : a + 4 * size]) for a in range(0, 4 * (n - rest), 4 * size)]
                    marks, crc, at = [], 0, 4 * (n - rest)
                    for end in range(at + 4 * grid, 4 * n, 4 * grid):
                        crc = zlib.crc32(ids[at:end], crc)
                        marks.append(crc)
                        at = end
                    if rest:
                        crcs.append(zlib.crc32(ids[at:], crc))
                    rows.append((name, task, n, full, int(seen[rest]), crcs, np.array(marks, "<u4").tobytes()))
                    full += n // size
                    seen[rest] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                first += len(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, ENCODED)


PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def placed(pieces: DataFrame, places: Places, grid: int = GRID) -> DataFrame:
    """The parts of pieces (doc_id, doc_tokens, start, length, rank, crc, marks) in their sequences."""

    def run(batches):
        for batch in batches:
            start, length, rank, crc = (batch.column(c).to_numpy() for c in ("start", "length", "rank", "crc"))
            marks = batch.column("marks")
            todo, at, found = np.arange(len(start)), np.zeros(len(start), np.int64), []
            while len(todo):
                part, sequence, offset = places.of(length[todo], rank[todo], at)
                end, own = at + part, crc[todo].copy()
                cut = np.flatnonzero(part < length[todo])
                if len(cut):
                    value = lambda k, x: int.from_bytes(marks[int(todo[k])].as_py()[4 * (x // grid) - 4 : 4 * (x // grid)], "little") if x else 0
                    upto = np.array([own[k] if end[k] == length[todo[k]] else value(k, int(end[k])) for k in cut])
                    own[cut] = crc_of_rest(upto, np.array([value(k, int(at[k])) for k in cut]), part[cut])
                found.append((todo, start[todo] + at, part, own, sequence, offset))
                more = np.flatnonzero(end < length[todo])
                todo, at = todo[more], end[more]
            row, begin, part, own, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array(begin), pa.array(part), pa.array(own), batch.column("doc_tokens").take(take), pa.array(sequence), pa.array(offset)], [c.split()[0] for c in PLACED.split(", ")])

    return pieces.select("doc_id", "doc_tokens", "start", "length", "rank", "crc", "marks").mapInArrow(run, PLACED)


def pack(docs: DataFrame, tokeniser: str, size: int = SIZE, end_id: int = END_ID, grid: int = GRID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    whole = staged(encoded(docs, tokeniser, size, end_id, grid), "encoded")
    rest = (F.col("n_tokens") % size).alias("length")
    n_full = F.floor(F.col("n_tokens") / size)
    each = whole.select("task", F.inline(F.array(F.struct(F.lit(size).cast("long").alias("length"), n_full.alias("n")), F.struct(rest, (rest > 0).cast("long").alias("n")))))
    by_task = staged(each.filter("n > 0").groupBy("task", "length").agg(F.sum("n").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = Places(packed(histogram, size, grid), size)
    # How many pieces of a length the tasks before hold: a row a task and length, never a row a piece.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_task.select("task", "length", before.alias("before"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), n_full), lambda k: F.struct((k * size).alias("start"), F.lit(size).cast("long").alias("length"), (F.col("first_full") + k).alias("own"), F.get("crcs", k.cast("int")).alias("crc"), F.lit(None).cast("binary").alias("marks")))
    last = F.struct((n_full * size).alias("start"), rest, F.col("rest_rank").alias("own"), F.get("crcs", n_full.cast("int")).alias("crc"), F.col("marks"))
    pieces = whole.select("doc_id", "task", F.col("n_tokens").alias("doc_tokens"), F.inline(F.concat(F.slice(full, F.lit(1), n_full.cast("int")), F.filter(F.array(last), lambda p: p["length"] > 0))))
    ranked = pieces.join(small_side(before), ["task", "length"]).withColumn("rank", F.col("before") + F.col("own"))
    return placed(ranked, places, grid)
