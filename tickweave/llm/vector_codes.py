"""Vector code compression: product quantisation in integers, assigned with adaptive distance bounds.

Each component x becomes floor(SCALE * x); vectors are cut into PARTS consecutive parts, and the parts of one position
share a codebook of ENTRIES entries. A round assigns every part to the nearest entry and moves each entry to the
componentwise floor of its parts' mean.

What an assignment learns is kept, as adaptive bounds do it (Drake and Hamerly): for each part the b closest entries, an
upper bound of the distance to the first, ordered lower bounds of the others, and one outer bound for all entries
that aren't listed. When entries move, the bounds move by as much; a part whose upper bound stays under all lower
ones needs no distance. Bounds are floats, rounded away from certainty; wherever they don't decide, squared
distances are compared in integers: to the entry at hand, then to the listed ones, then to all. After each round b shrinks
to what the parts that had to be looked at needed, all but a 64th of them, and to an eighth of the entries at least.

One pass over the vectors a round: it writes vectors and bounds to the shared folder (two folders take turns) and, a row a
task, the change of the entries' sums; those rows are summed by Spark, and only codebooks pass through the driver.

Defined results: null vectors and those with null or non-finite components are dropped; an empty vector has parts of no
components, and vectors of unequal length, or of one that PARTS doesn't divide, count as padded with zeros to the next common
multiple; with fewer than ENTRIES kept vectors there are as many entries as vectors; equal vec_ids seed in order of
their components, null vec_ids after all others; repeated rows are coded each; without kept vectors the result is
empty; further columns are not read. Components whose squared distances don't fit 64 bits raise an ArithmeticError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import scratch, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative slack of a bound that is computed from an exact distance; more than single floats round off.
SLACK = 1e-6
#: Share of the parts looked at whose entry may lie outside the list after b has shrunk.
OUTSIDE = 1 / 64
#: Vectors that a task handles at once.
ROWS = 4096
#: Labels that are broadcast with their errors; the most frequent ones, where there are more.
FEW_LABELS, HEAVY = 200_000, 50_000
STATE = "vec_id bigint, label {label}, parts binary, bounds binary, changes array<bigint>"


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (array<double>) of the vectors without null or non-finite components."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col(vector).cast("array<double>").alias("vector"))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(SCALE))))


def bound_dtype(b: int) -> np.dtype:
    """Of one part: the b closest entries, bounds of the distance to each (from above for the first, from below for the others), and the outer bound."""
    return np.dtype([("near", "u1", (b,)), ("low", "<f4", (b,)), ("outer", "<f4")])


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between x (n, d) and entries (k, d), or of each row of x to its own entries (n, k, d)."""
    most = sum(int(max(-a.min(initial=0), a.max(initial=0))) for a in (x, entries))
    if x.shape[-1] * most * most >= 1 << 62:
        raise ArithmeticError("squared distances of these vectors don't fit 64 bits")
    if entries.ndim == 2 and 4 * x.shape[-1] * most * most < 1 << 53:  # floats hold such integers exactly, and multiply fast
        a, c = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    diff = x[:, None, :] - entries
    return (diff * diff).sum(-1)


def _ranked(dist: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and distances by distance, ties to the lower name."""
    order = np.lexsort((names, dist), axis=-1)
    return np.take_along_axis(names, order, -1), np.take_along_axis(dist, order, -1)


def _bounds(dist: np.ndarray) -> np.ndarray:
    """Bounds from exact ordered squared distances: from above in the first column, from below in the others."""
    out = np.sqrt(dist.astype(float)) * (1 - SLACK)
    out[:, 0] = np.sqrt(dist[:, 0].astype(float)) * (1 + SLACK)
    return out


def search(x: np.ndarray, part: np.ndarray, books: np.ndarray, b: int, state: np.ndarray) -> None:
    """Sets the state of parts x (n, d) of positions part from the distances to all entries."""
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        dist = squared(x[own], books[p])
        names, dist = _ranked(dist, np.broadcast_to(np.arange(books.shape[1], dtype=np.uint8), dist.shape))
        found = _bounds(dist)
        state["near"][own], state["low"][own] = names[:, :b], found[:, :b]
        state["outer"][own] = found[:, b] if b < books.shape[1] else np.inf


def advance(x: np.ndarray, part: np.ndarray, books: np.ndarray, moves: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Brings the state of parts up to books, whose entries have moved by at most moves; the place of each part's entry in its old list.

    Places: 0 for a part that needed no search, -1 for one that was checked and stayed, the length of the list if all entries were compared.
    """
    b, k = state["near"].shape[1], books.shape[1]
    low = state["low"].astype(float)
    moved = moves[part[:, None], state["near"]]
    low[:, 0] += moved[:, 0]
    low[:, 1:] -= moved[:, 1:]
    outer = state["outer"].astype(float) - moves.max(1)[part]
    rivals = np.minimum(low[:, 1:].min(1, initial=np.inf), outer)
    place = np.zeros(len(x), np.int64)
    unsure = np.flatnonzero(low[:, 0] >= rivals)
    if len(unsure):  # the upper bound anew, from integers
        at = books[part[unsure], state["near"][unsure, 0]]
        low[unsure, 0] = np.sqrt(squared(x[unsure], at[:, None, :])[:, 0].astype(float)) * (1 + SLACK)
        place[unsure] = -1
        unsure = unsure[low[unsure, 0] >= rivals[unsure]]
    inside = unsure[low[unsure, 0] < outer[unsure]]
    for first in range(0, len(inside), ROWS):
        own = inside[first : first + ROWS]
        before = state["near"][own]
        names, dist = _ranked(squared(x[own], books[part[own, None], before]), before)
        place[own] = (before == names[:, :1]).argmax(1)
        place[own[place[own] == 0]] = -1
        state["near"][own], low[own] = names, _bounds(dist)
    # Lower bounds in order, so that what b drops is the largest; single floats, rounded away from certainty.
    if b > 2:
        order = np.argsort(low[:, 1:], 1, kind="stable")
        low[:, 1:] = np.take_along_axis(low[:, 1:], order, 1)
        state["near"][:, 1:] = np.take_along_axis(state["near"][:, 1:], order, 1)
    state["low"] = np.nextafter(low.astype("<f4"), np.float32(-np.inf))
    state["low"][:, 0] = np.nextafter(low[:, 0].astype("<f4"), np.float32(np.inf))
    state["outer"] = np.nextafter(outer.astype("<f4"), np.float32(-np.inf)) if b < k else np.inf
    far = unsure[low[unsure, 0] >= outer[unsure]] if b < k else unsure[:0]
    if len(far):
        new = state[far]
        search(x[far], part[far], books, b, new)
        state[far] = new
        place[far] = b
    return place


def _shrunk(state: np.ndarray, b: int) -> np.ndarray:
    """The state with lists of b entries; the bounds that go are folded into the outer bound."""
    if b == state["near"].shape[1]:
        return state
    out = np.zeros(len(state), bound_dtype(b))
    out["near"], out["low"] = state["near"][:, :b], state["low"][:, :b]
    out["outer"] = np.minimum(state["outer"], state["low"][:, b:].min(1))
    return out


def _sums(x: np.ndarray, part: np.ndarray, entry: np.ndarray, k: int, into: np.ndarray, sign: int) -> None:
    """Adds parts and their number to the sums (PARTS * k, d + 1)."""
    key = part * k + entry
    order = np.argsort(key, kind="stable")
    if len(order):
        firsts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        at = key[order][firsts]
        into[at, :-1] += sign * np.add.reduceat(x[order], firsts, axis=0)
        into[at, -1] += sign * np.diff(np.append(firsts, len(order)))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows[0].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Integer components of vectors of any length up to dims, zeros behind."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    if len(values) and np.abs(values).max() >= 1 << 31:
        raise ArithmeticError("squared distances of these vectors don't fit 64 bits")
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def assigned(rows: DataFrame, books: np.ndarray, moves: np.ndarray | None, b_before: int, b: int) -> DataFrame:
    """One pass: rows of kept() (moves None) or of the pass before, to STATE; the rows with changes have nothing else."""
    k, d = books.shape[1], books.shape[2]
    dims, kind = d * PARTS, rows.schema["label"].dataType.simpleString()

    def run(batches):
        change, places = np.zeros((PARTS * k, d + 1), np.int64), np.zeros(b_before + 2, np.int64)
        arrow = None
        for whole in batches:
            arrow = arrow or pa.schema([("vec_id", pa.int64()), ("label", whole.schema.field("label").type), ("parts", pa.binary()), ("bounds", pa.binary()), ("changes", pa.list_(pa.int64()))])
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                n = batch.num_rows
                part = np.tile(np.arange(PARTS), n)
                if moves is None:
                    x = _padded(batch.column("vector"), dims).reshape(n * PARTS, d)
                    state = np.zeros(n * PARTS, bound_dtype(b_before))
                    search(x, part, books, b_before, state)
                    _sums(x, part, state["near"][:, 0].astype(np.int64), k, change, 1)
                else:
                    x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i4").astype(np.int64).reshape(n * PARTS, d)
                    state = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), bound_dtype(b_before)).copy()
                    old = state["near"][:, 0].astype(np.int64)
                    place = advance(x, part, books, moves, state)
                    places += np.bincount(place + 1, minlength=b_before + 2)
                    new = state["near"][:, 0].astype(np.int64)
                    other = np.flatnonzero(old != new)
                    _sums(x[other], part[other], old[other], k, change, -1)
                    _sums(x[other], part[other], new[other], k, change, 1)
                columns = [batch.column("vec_id"), batch.column("label"), _binary(x.astype("<i4").reshape(n, dims)), _binary(_shrunk(state, b).reshape(n, PARTS)), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if arrow is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in arrow.types[:4]] + [pa.array([np.concatenate([change.ravel(), places]).tolist()], pa.list_(pa.int64()))], schema=arrow)

    return rows.mapInArrow(run, STATE.format(label=kind))


def changes(state: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' changes; Spark adds them up, place by place."""
    found = state.filter("changes is not null").select(F.posexplode("changes").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = np.zeros(size, object)
    for row in found.collect():  # one row for each component of the codebooks
        out[row["at"]] = int(row["x"])
    return out


def seeds(own: DataFrame, dims: int, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (PARTS, entries, dims / PARTS) of the vectors with the smallest vec_ids."""
    first = own.select("vec_id", integers(F.col("vector")).alias("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    whole = np.zeros((len(first), dims), np.int64)
    for row, r in zip(whole, first, strict=True):
        row[: len(r["x"])] = r["x"]
    return whole.reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2)


def moved(books: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks after an update by exact sums (parts, entries, d + 1), and bounds of how far each entry has moved."""
    new = books.copy()
    for p, e in zip(*np.nonzero(sums[:, :, -1]), strict=True):
        new[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
    diff = (new - books).astype(float)
    return new, np.sqrt((diff * diff).sum(-1)) * (1 + SLACK)


def shorter(places: np.ndarray, b: int, least: int) -> int:
    """The list length that would have done for all but OUTSIDE of the parts that were looked at. places: of advance(), from -1."""
    looked = [int(places[0]), *map(int, places[2:])]  # stayed, found at 1, 2, ..., outside
    total, upto = sum(looked), 0
    for needed, n in enumerate(looked[:-1], 1):
        upto += n
        if total - upto <= OUTSIDE * total:
            return min(b, max(needed, least))
    return b


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every kept vector, and the codebooks (parts, entries, components)."""
    spark, own = vectors.sparkSession, kept(vectors, vector)
    longest = own.agg(F.max(F.size("vector"))).first()[0]
    kind = own.schema["label"].dataType.simpleString()
    shape = f"vec_id bigint, label {kind}, code string, error bigint"
    if longest is None:
        return spark.createDataFrame([], shape), np.zeros((PARTS, 0, 0), np.int64)
    dims = -(-longest // PARTS) * PARTS
    books = seeds(own, dims)
    k, d = books.shape[1], books.shape[2]
    least = min(k, max(2, k // 8))
    b = b_before = min(k, max(least, k // 4))
    turns, rows, moves = [scratch(spark, "codes-a"), scratch(spark, "codes-b")], own, None
    sums = np.zeros(PARTS * k * (d + 1), object)
    for r in range(rounds):
        state = assigned(rows, books, moves, b_before, b)
        state.write.mode("overwrite").option("compression", "zstd").parquet(turns[r % 2])
        written = spark.read.schema(state.schema).parquet(turns[r % 2])
        size = PARTS * k * (d + 1)
        found = changes(written, size + b_before + 2)
        sums = sums + found[:size]
        b_before = b
        if r:
            b = shorter(found[size:], b, least)
        books, moves = moved(books, sums.reshape(PARTS, k, d + 1))
        rows = written.filter("changes is null")

    def last(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                own = batch.slice(first, ROWS)
                n = own.num_rows
                part = np.tile(np.arange(PARTS), n)
                x = np.frombuffer(b"".join(own.column("parts").to_pylist()), "<i4").astype(np.int64).reshape(n * PARTS, d)
                state = np.frombuffer(b"".join(own.column("bounds").to_pylist()), bound_dtype(b_before)).copy()
                advance(x, part, books, moves, state)
                entry = state["near"][:, 0]
                diff = x - books[part, entry]
                error = (diff * diff).sum(1).reshape(n, PARTS).sum(1)
                text = entry.tobytes().hex()
                codes = [text[a : a + 2 * PARTS] for a in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "parts", "bounds").mapInArrow(last, shape), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (a stored table) with label_error: the errors summed over equal labels, nulls together."""
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    small = totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    most = totals if small else staged(totals.orderBy(F.desc("_n"), "_label").limit(HEAVY), "labels")
    out = coded.join(F.broadcast(most.drop("_n")), F.col("label").eqNullSafe(F.col("_label")), "left")
    if small:
        return out.drop("_label")
    # No label that is left holds more than a HEAVY-th of the rows, so they can be dealt by label.
    rest = coded.join(F.broadcast(most.select("_label")), F.col("label").eqNullSafe(F.col("_label")), "left_anti")
    rest = rest.join(totals.drop("_n"), F.col("label").eqNullSafe(F.col("_label")))
    return out.filter("label_error is not null").unionByName(rest).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, vector)
    whole = with_label_error(staged(coded, "coded"))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
