"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of codepoint classes. Each class is a transition function over a few states;
functions of blocks of characters are composed by an associative scan, which gives every character's state and
so the token boundaries, with no regex. The slices feed pair merging behind a bounded cache, and the ids keep
the offsets of their pre-tokens, from which any slice can be decoded.

The boundaries are those of the public pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of
numbers or of other marks, each with one blank before it, and white space, whose last character is left to
what follows.

A task's memory is bounded whatever the texts: they are encoded CHARS_A_CHUNK characters at a time, a longer text
in pieces that begin where white space follows another character (a token always begins there, and what comes
before doesn't change how what follows is cut), and the cache of merged pre-tokens is bounded in bytes.

Defined results: a null text counts as empty and gives no ids; very long texts are handled in whole; repeated
rows are encoded alike; further columns pass through (one that is named as an output is replaced); an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.base import fresh

# Symbols of characters.
LETTER, NUMBER, OTHER, TICK1, TICK2, BLANK_LAST, SPACE_LAST, SPACE, RESET = range(9)
# States: what the token so far is.
IN_L, IN_N, IN_O, IN_S, AFTER_BLANK, NEED1, NEED2, CLOSED = range(8)
CHARS_A_CHUNK = 1 << 18
BLOCK = 256
#: Bytes of merged pre-tokens that a Python worker keeps; a full cache begins anew.
CACHE_BYTES = 24 << 20
#: Bytes of a pre-token that is merged on its own.
LONG = 64
#: No rank.
NONE = (1 << 31) - 1
#: The characters with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SET = frozenset(WHITE)


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and starts[symbol * 8 + state]: whether a token starts at that character."""
    nxt, new = np.full((9, 8), CLOSED, np.uint8), np.ones((9, 8), bool)
    for symbol, own in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        nxt[symbol] = own
        new[symbol, [own, AFTER_BLANK]] = False
    nxt[LETTER, NEED1], nxt[LETTER, NEED2] = CLOSED, NEED1
    new[LETTER, [NEED1, NEED2]] = False
    for symbol, need in ((TICK1, NEED1), (TICK2, NEED2)):  # a contraction only where the mark begins a token
        nxt[symbol] = need
        nxt[symbol, [IN_O, AFTER_BLANK]] = IN_O
        new[symbol, [IN_O, AFTER_BLANK]] = False
    nxt[BLANK_LAST] = AFTER_BLANK
    nxt[SPACE] = IN_S
    new[SPACE, IN_S] = False
    new[RESET] = False
    return nxt.ravel(), new.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every codepoint, by the library's own tables: a byte vocabulary whose pattern is one class gives back the characters of that class."""
    import tiktoken

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    whole, single = points.tobytes().decode("utf-32-le"), {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(whole))
        out[np.frombuffer(found.decode().encode("utf-32-le"), "<u4")] = kind
    out[WHITE] = SPACE
    return out


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of the characters; breaks: places between texts, which the placeholder characters there hold."""
    sym = classes()[points]
    sym[breaks] = RESET
    after = np.append(sym[1:], RESET)
    last = (sym == SPACE) & (after != SPACE) & (after != RESET)
    sym[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    ticks = np.flatnonzero((points == 0x27) & (sym == OTHER))
    if len(ticks):
        wide = np.append(points, [0, 0])
        a, b = wide[ticks + 1], wide[ticks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[ticks[one]] = TICK1
        sym[ticks[two]] = TICK2
    return sym


def token_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Places where tokens start."""
    nxt, new = machine()
    sym = symbols(points, breaks)
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, RESET, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) * np.uint8(8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for step in grid:  # each block's transition function, for every state it may begin in
        whole = nxt[step[:, None] + whole]
    width = 1
    while width < rows:  # associative scan: functions composed over doubling spans of blocks
        whole[width:] = np.take_along_axis(whole[width:], whole[:-width].astype(np.intp), 1)
        width *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = CLOSED, whole[:-1, CLOSED]
    starts = np.empty((BLOCK, rows), bool)
    for j, step in enumerate(grid):
        at = step + state
        starts[j] = new[at]
        state = nxt[at]
    return np.flatnonzero(starts.T.ravel()[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Pairs:
    """Which pairs of ids merge to which id: an open hash table in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for whole, k in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = k
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        self.bits = max(4, (2 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):  # of keys that want one free slot the last gets it, the others try the next
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The id of each pair (first << 32 | second), NONE without one."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (self._slot(keys[open_]) + _ + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != -1)]
        return out


def merge_all(tokens: list[bytes], ranks: dict[bytes, int], pairs: Pairs, singles: np.ndarray) -> list[bytes]:
    """Ids of each pre-token as little-endian 32-bit integers. In every turn each pre-token merges its adjacent pair of
    least rank (the first of equals), until none has a pair with a rank."""
    out: list[bytes] = [b""] * len(tokens)
    short = []
    for k, t in enumerate(tokens):
        if (whole := ranks.get(t)) is not None:
            out[k] = struct.pack("<i", whole)
        elif len(t) > LONG:
            out[k] = np.array(_merge_long(t, ranks), "<i4").tobytes()
        else:
            short.append(k)
    if not short:
        return out
    ids = singles[np.frombuffer(b"".join([tokens[k] for k in short]), np.uint8)]
    token = np.repeat(np.array(short), [len(tokens[k]) for k in short])
    while True:
        rank = pairs.get(ids[:-1].astype(np.int64) << 32 | ids[1:])
        rank = np.append(np.where(token[:-1] == token[1:], rank, NONE), NONE)
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(first, len(token)))
        least = np.minimum.reduceat(rank, first)
        done = least == NONE
        if done.any():  # these have no pair left
            over = np.repeat(done, sizes)
            flat = ids[over].astype("<i4").tobytes()
            ends = 4 * np.cumsum(sizes[done])
            for k, a, b in zip(token[first[done]].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[k] = flat[a:b]
            ids, token, rank = ids[~over], token[~over], rank[~over]
            least, sizes = least[~done], sizes[~done]
            if not len(ids):
                return out
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        at = at[np.append(True, token[at[1:]] != token[at[:-1]])]
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, token = ids[keep], token[keep]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same of one pre-token of any length, with a heap."""
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes lists of texts and decodes ids; keeps a bounded cache of pre-tokens. One for each Python worker and rank file."""

    def __init__(self, path: str):
        self.ranks, self.cache, self.held = read_ranks(path), {}, 0
        self.pairs, self.singles = Pairs(self.ranks), np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, k in self.ranks.items():
            pieces[k] = piece
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def learn(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens as little-endian 32-bit integers; the cache keeps them."""
        found = dict(zip(tokens, merge_all([t.encode() for t in tokens], self.ranks, self.pairs, self.singles), strict=True))
        for t, ids in found.items():
            if len(t) < LONG:
                self.held += 240 + 2 * len(t) + len(ids)  # with what Python adds to each entry
                if self.held > CACHE_BYTES:
                    self.cache, self.held = {}, 0
                self.cache[t] = ids
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, ids of each text, offset of each id's pre-token (characters in its text)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum(sizes + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = token_starts(points, ends)
        firsts = ends - sizes
        # A token ends where the next begins or its text ends.
        text_no = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], len(points)), ends[text_no]) if len(starts) else starts
        tokens = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        found = list(map(self.cache.get, tokens))
        new = self.learn(list({t: None for t, ids in zip(tokens, found, strict=True) if ids is None}))
        if new:
            found = [ids or new[t] for t, ids in zip(tokens, found, strict=True)]
        per_token = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<i4")
        counts = np.bincount(text_no, weights=per_token, minlength=len(texts)).astype(np.int64)
        return ids, counts, np.repeat((starts - firsts[text_no]).astype(np.int32), per_token)

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one text of any length, a piece at a time."""
        ids, offsets = [], []
        first = 0
        for piece in pieces(text):
            own, _, at = self.encode([piece])
            ids.append(own)
            offsets.append(at + np.int32(first))
            first += len(piece)
        ids, offsets = np.concatenate(ids), np.concatenate(offsets)
        return ids, np.array([len(ids)]), offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        sizes = self.sizes[ids]
        shift = self.firsts[ids] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(sizes.sum())]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each list of ids, CHARS_A_CHUNK ids at a time."""
        parts, ends = [], np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds].astype(np.int32)
        for first in range(0, len(ids), CHARS_A_CHUNK):
            parts.append(self.decode(ids[first : first + CHARS_A_CHUNK]).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(parts))])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Where white space follows another character.
TURN = re.compile(r"(?<=\S)\s")


def pieces(text: str):
    """The text in pieces of about CHARS_A_CHUNK characters, cut where white space follows another character."""
    first = 0
    while len(text) - first > CHARS_A_CHUNK and (cut := _turn(text, first + CHARS_A_CHUNK)) is not None:
        yield text[first:cut]
        first = cut
    yield text[first:]


def _turn(text: str, first: int) -> int | None:
    """The next place from first on where Unicode white space follows a character that is none."""
    while (found := TURN.search(text, first)) is not None:
        # The expression's white space has a few control characters more than Unicode's.
        if ord(found[0]) in WHITE_SET and ord(text[found.start() - 1]) not in WHITE_SET:
            return found.start()
        first = found.end()
    return None


def chunks(texts: pa.Array):
    """(first, texts) of bounded size in characters; a longer text is a chunk of its own."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        if held and size + len(t) > CHARS_A_CHUNK:
            yield first, held
            held, size, first = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _encoded(docs: DataFrame, path: str, text: str, back: bool) -> DataFrame:
    """The columns of docs without text, ids, offsets and, if back, the bytes decoded from the ids by the same task."""
    own = ("ids", "offsets", "decoded") if back else ("ids", "offsets")
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in own]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*keep, *(T.StructField(n, T.BinaryType() if n == "decoded" else ints) for n in own)])
    [held] = fresh(docs, "_text")

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for first, texts in chunks(batch.column(held)):
                ids, counts, offsets = coder.encode_long(texts[0]) if len(texts) == 1 else coder.encode(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (ids, offsets)]
                if back:
                    columns.append(coder.decoded(ids, bounds))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *columns], schema.names)

    return docs.select(*[f.name for f in keep], F.col(text).alias(held)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of docs without text, and ids, offsets (array<int>)."""
    return _encoded(docs, path, text, False)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode, and decoded (binary): the ids back as bytes, in the same Python worker."""
    return _encoded(docs, path, text, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded (binary), from ids alone; null ids give empty bytes."""
    keep = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*keep, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in part.column("ids")]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), coder.decoded(np.concatenate(lists), bounds)], schema.names)

    return encoded.select(*[f.name for f in keep]).mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
