"""Token ids as files: an adaptive context-mixing range coder.

A block holds up to BLOCK ids and stands alone: its models start empty and its header carries the number of
ids and the crc32 of their bytes, checked when it is read. Three models predict each id:

* order 2, the id last seen after the same two ids, and how often that guess held;
* order 1, likewise after the one id before;
* order 0, adaptive frequencies of the id's digits (base 41, most significant first, each digit in the
  context of those before it, in classes of fixed number).

The guesses' confidences, and whether they agree, choose an adaptive split of the range into "order 2 was right",
"order 1 was right" and "neither"; in the last case order 0 codes the digits. A range coder turns the intervals
into bytes, 16 bits at a time; carries are added to what has been written when a block ends. Many blocks are coded
side by side, one lane of a numpy array each; lanes never share a model, so any block decodes alone.

The container is Parquet, written and read by Spark: one row a block (file_no, block_no, n_ids, payload), and an
index of documents (doc_id, file_no, place, n_tokens). Files are in ascending doc_id order.

Defined results: a null text counts as empty and gives the end id alone; very long texts are handled in whole and
may span blocks; documents of equal id go by text; repeated rows are written each; an empty table gives files
without blocks; further columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.base import small_side, text_of

BLOCK = 8192
END_ID = 1
MAGIC = b"CMR2"
#: Slots of each guess table of a block, a power of two.
SLOTS = 1 << 12
BITS = 14
TOTAL = 1 << BITS
#: Digits of an id, and the classes of their contexts: none before, one before, two before (hashed).
BASE, CLASSES = 41, (1, 41, 256)
#: Least part of the range that a digit, and that a guess keeps.
LEAST_DIGIT, LEAST_GUESS = 16, 32
#: Blocks coded side by side, whatever a task holds; about 60 KB of models, 32 KB of ids and 24 KB of code each.
LANES = 1024
#: Ids of each lane that are written at once, and symbols of each lane that are made ready at once.
WINDOW, SLAB = 256, 64
#: Lanes whose rows or pieces are sorted at once, by keys of 16 bits (so LANES * BASE is below 65,536 too).
PARTS = 128
SHIFT = np.uint64(BITS)
FULL, LOW = np.uint64(1 << 48), np.uint64(1 << 32)
LOW_BITS, PIECE = np.uint64((1 << 32) - 1), np.uint64(16)

#: Digits of every id below 65,536, the most significant first.
DIGITS = np.stack([np.arange(1 << 16) // BASE**2, np.arange(1 << 16) // BASE % BASE, np.arange(1 << 16) % BASE]).astype(np.int64)
DIGITS8 = DIGITS.astype(np.uint8)
#: Cumulative frequencies towards which a seen digit moves: all of the range but the least part for each digit.
GOALS = np.array([[k * LEAST_DIGIT + (TOTAL - BASE * LEAST_DIGIT if k > d else 0) for k in range(BASE + 1)] for d in range(BASE)], np.int16)
#: A row of cumulative frequencies as one item: numpy copies it in one go.
CELL = np.dtype(f"V{2 * (BASE + 1)}")
#: Parts of the two guesses towards which an outcome (order 2, order 1, neither) moves them, if they differ and if they agree.
MOST = TOTAL - TOTAL // 64 - LEAST_GUESS
#: By outcome * 2 + whether they agree, order 2's goals before order 1's.
GOALS_OF = np.array([MOST, MOST, LEAST_GUESS, LEAST_GUESS, LEAST_GUESS, LEAST_GUESS, LEAST_GUESS, 0, MOST, 0, LEAST_GUESS, 0], np.int64)
ORDER1 = np.array([[0], [len(GOALS_OF) // 2]])
#: What a table's slot of an id comes from, and a guess's sureness after it was right (0 to 3) or wrong (from 4 on).
FACTORS = np.array([[30011], [40503]])
SURER = np.array([1, 2, 3, 3, 0], np.int32)


def towards(goal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n moved a sixteenth of the way to goal (which is overwritten)."""
    goal -= n
    goal >>= 4
    goal += n
    return goal


def guess_again(guess: np.ndarray, slot: np.ndarray, entry: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Adapts the entries at these slots to ids (fresh = id * 4); says by how much an entry differs, under 4 where it guessed right."""
    off = entry ^ fresh
    new = SURER.take(np.minimum(off, 4))
    new += fresh
    sure = (entry & 2).astype(bool)
    sure &= off > 3
    stays = sure.ravel().nonzero()[0]  # wrong, but sure enough to keep the guess
    if len(stays):
        new.ravel()[stays] = entry.ravel()[stays] & -4 | 1
    guess[slot] = new
    return off


def first_rows(lanes: int) -> np.ndarray:
    """A row of cumulative frequencies for each context of each lane."""
    return np.tile(np.linspace(0, TOTAL, BASE + 1).astype(np.int16), (lanes * sum(CLASSES), 1))


class Guesses:
    """Orders 2 and 1 of `lanes` blocks at once. Arrays of two rows hold what is of order 2 before what is of order 1."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.at = np.stack([lane * SLOTS, (lanes + lane) * SLOTS])
        # A guess and how sure it is (0 to 3), as guess * 4 + sureness.
        self.guess = np.zeros(2 * lanes * SLOTS, np.int32)
        # Parts of the range by both sureness and agreement; a second guess that agrees has none.
        self.at32 = np.stack([lane * 32, (lanes + lane) * 32])
        self.part = np.concatenate([np.full(lanes * 32, TOTAL // 4), np.tile([TOTAL // 8, 0], lanes * 16)])
        self.older, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def split(self) -> None:
        """The guesses g of order 2 and of order 1, whether they agree, and their parts n."""
        self.slot = self.last * FACTORS
        older = self.slot[1].copy()
        self.slot[0] += self.older
        self.slot[1] >>= 3
        self.slot &= SLOTS - 1
        self.slot += self.at
        self.older = older
        self.entry = self.guess.take(self.slot)
        self.g = self.entry >> 2
        self.same = self.g[0] == self.g[1]
        sure = self.entry & 3
        sure[0] <<= 2
        sure[0] += sure[1]
        sure[0] <<= 1
        sure[0] += self.same
        self.k = self.at32 + sure[0]
        self.n = self.part.take(self.k)

    def learn(self, x: np.ndarray, outcome: np.ndarray) -> None:
        """Adapts guesses and parts to the ids x."""
        goal = outcome << 1
        goal += self.same
        self.part[self.k] = towards(GOALS_OF.take(goal + ORDER1), self.n)
        guess_again(self.guess, self.slot, self.entry, x.astype(np.int32) << 2)
        self.last = x


class Models(Guesses):
    """All models of `lanes` blocks at once, for the reader: an id's digits come to be known one after the other."""

    def __init__(self, lanes: int):
        super().__init__(lanes)
        lane, self.cum = np.arange(lanes), first_rows(lanes)
        self.cells = self.cum.view(CELL).ravel()
        # Rows are copied here and there, and changed here, without a new array for each step.
        self.rows, self.goals = np.empty((lanes, BASE + 1), np.int16), np.empty((lanes, BASE + 1), np.int16)
        self.flat, self.at_row = self.rows.ravel(), lane * (BASE + 1)
        self.base = lane * sum(CLASSES)

    def context(self, base: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
        if not digits:
            return base
        if len(digits) == 1:
            return base + (digits[0] + CLASSES[0])
        return base + (((digits[0] * BASE + digits[1]) * 37 & (CLASSES[2] - 1)) + (CLASSES[0] + CLASSES[1]))

    def look(self, context: np.ndarray) -> np.ndarray:
        """The contexts' rows, valid until the next call. Contexts are in bounds; with mode clip numpy writes to out without a buffer between."""
        return np.take(self.cum, context, axis=0, out=self.rows[: len(context)], mode="clip")

    def span(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each digit in its row."""
        at = self.at_row[: len(digit)] + digit
        start = self.flat.take(at)
        at += 1
        return start, self.flat.take(at) - start

    def adapt(self, context: np.ndarray, rows: np.ndarray, digit: np.ndarray) -> None:
        goals = np.take(GOALS, digit, axis=0, out=self.goals[: len(digit)], mode="clip")
        goals -= rows
        goals >>= 4
        rows += goals
        self.cells[context] = rows.view(CELL).ravel()


class Digits:
    """Order 0 of many lanes where all ids are known beforehand: a context's row meets its digits one after the other,
    but all rows of all lanes take their next one at once, so that no row is looked up or put back at a step."""

    def __init__(self, lanes: int):
        self.cum = first_rows(lanes)

    def symbols(self, lane: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Start << 16 | size of the three digits of each id x, (3, ids); ids of one lane are in order."""
        digits = DIGITS8[:, x]
        first, second = digits[0].astype(np.int32), digits[1].astype(np.int32)
        third = (first * BASE + second) * 37 & (CLASSES[2] - 1)
        base = lane * np.int32(sum(CLASSES))
        rows = [base, base + (first + CLASSES[0]), base + (third + (CLASSES[0] + CLASSES[1]))]
        # Stable orders by row; keys of 16 bits, as numpy sorts those by counting.
        orders = [np.argsort(lane.astype(np.uint16), kind="stable"), np.argsort((lane * BASE + first).astype(np.uint16), kind="stable")]
        parts = []
        for a in range(0, int(lane.max(initial=-1)) + 1, PARTS):
            own = ((lane >= a) & (lane < a + PARTS)).nonzero()[0]
            parts.append(own[np.argsort(((lane[own] - a) * CLASSES[2] + third[own]).astype(np.uint16), kind="stable")])
        orders.append(np.concatenate(parts))
        n = len(x)
        digit = np.concatenate([d[o] for d, o in zip(digits, orders, strict=True)]).astype(np.intp)
        row = np.concatenate([r[o] for r, o in zip(rows, orders, strict=True)])
        begins = np.append(True, row[1:] != row[:-1]).nonzero()[0]
        counts = np.diff(np.append(begins, len(row)))
        by_count = np.argsort(-counts, kind="stable")
        at, counts = begins[by_count], counts[by_count]
        row = row[at]
        cum = self.cum[row]
        flat, to_row, goals = cum.ravel(), np.arange(len(cum)) * (BASE + 1), np.empty_like(cum)
        starts, ends = np.empty(3 * n, np.int16), np.empty(3 * n, np.int16)
        # Rows that still have a digit at each step: those before this place.
        still = len(counts) - np.cumsum(np.bincount(counts))
        for left in still[:-1].tolist():
            place, own, goal = at[:left], cum[:left], goals[:left]
            d = digit.take(place)
            np.take(GOALS, d, axis=0, out=goal, mode="clip")
            d += to_row[:left]
            starts[place] = flat.take(d)
            d += 1
            ends[place] = flat.take(d)
            goal -= own
            goal >>= 4
            own += goal
            place += 1
        self.cum[row] = cum
        found = starts.astype(np.uint32) << np.uint32(16) | (ends - starts).astype(np.uint32)
        out = np.empty((3, n), np.uint32)
        for k, o in enumerate(orders):
            out[k, o] = found[k * n : k * n + n]
        return out


class Writer:
    """A range encoder of many lanes. The range is of 32 to 48 bits; a symbol takes at most BITS, so one piece of 16 leaves at a time."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, FULL, np.uint64)
        self.lanes, self.pieces = [], []  # what has left, in order, a piece holding a carry as its 17th bit

    def put(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        """symbols: start << 16 | size of each lane's next ones, a lane a column, of which counts hold."""
        by_count = np.argsort(-counts, kind="stable")
        low, rng = self.low[by_count], self.range[by_count]
        part, move, small = np.empty_like(low), np.empty_like(low), np.empty(len(low), bool)
        still = len(counts) - np.cumsum(np.bincount(counts))
        lanes, pieces = [], []
        for first in range(0, len(still) - 1, SLAB):
            slab = symbols[first : first + SLAB].take(by_count, axis=1)
            starts, sizes = (slab >> np.uint32(16)).astype(np.uint64), (slab & np.uint32(0xFFFF)).astype(np.uint64)
            for start, size, left in zip(starts, sizes, still[first : first + SLAB].tolist()):
                if left < len(low):
                    if not left:
                        break
                    self.low[by_count[left : len(low)]], self.range[by_count[left : len(low)]] = low[left:], rng[left:]
                    low, rng, part, move, small = low[:left], rng[:left], part[:left], move[:left], small[:left]
                np.right_shift(rng, SHIFT, out=part)
                np.multiply(part, start[:left], out=move)
                np.add(low, move, out=low)
                np.multiply(part, size[:left], out=rng)
                go = np.less(rng, LOW, out=small).nonzero()[0]
                if len(go):
                    own, r = low.take(go), rng.take(go)
                    lanes.append(go)
                    pieces.append(own)
                    low[go] = (own & LOW_BITS) << PIECE
                    r <<= PIECE
                    rng[go] = r
        self.low[by_count[: len(low)]], self.range[by_count[: len(low)]] = low, rng
        if lanes:
            self.lanes.append(by_count.astype(np.uint16)[np.concatenate(lanes)])
            self.pieces.append((np.concatenate(pieces) >> np.uint64(32)).astype(np.uint32))

    def finish(self) -> list[np.ndarray]:
        """The pieces of each lane, with carries added to those before."""
        everyone = np.arange(len(self.low), dtype=np.uint16)
        for _ in range(3):  # what is left in the registers
            self.lanes.append(everyone)
            self.pieces.append((self.low >> np.uint64(32)).astype(np.uint32))
            self.low = (self.low & LOW_BITS) << PIECE
        lanes, pieces = np.concatenate(self.lanes), np.concatenate(self.pieces)
        self.lanes, self.pieces = [], []
        out = []
        for first in range(0, len(everyone), PARTS):
            own = ((lanes >= first) & (lanes < first + PARTS)).nonzero()[0]
            own = own[np.argsort(lanes[own], kind="stable")]
            ends = np.cumsum(np.bincount(lanes[own] - np.uint16(first)))
            body = pieces[own]
            # A carry goes to the piece before; only a piece of all ones hands it on, so few rounds are needed.
            while len(over := (body >> np.uint32(16)).nonzero()[0]):
                body[over] &= np.uint32(0xFFFF)
                body[over - 1] += np.uint32(1)
            out += np.split(body.astype("<u2"), ends[:-1])
        return out


class Reader:
    """The decoder of what Writer wrote. Its code is relative to the low end of the range."""

    def __init__(self, bodies: list[np.ndarray]):
        data = np.zeros((len(bodies), max(map(len, bodies)) + 4 + 4 * SLAB), np.uint16)
        for row, body in zip(data, bodies, strict=True):
            row[: len(body)] = body
        first = data[:, :3].astype(np.uint64)
        self.code, self.range = (first[:, 0] << np.uint64(32)) | (first[:, 1] << PIECE) | first[:, 2], np.full(len(bodies), FULL, np.uint64)
        self.data, self.n = data.ravel(), np.arange(len(bodies)) * data.shape[1] + 3
        self.last = self.n + max(map(len, bodies))

    def stay(self) -> None:
        """Keeps lanes that are through within their own data: to be called every SLAB ids, of at most four pieces each."""
        np.minimum(self.n, self.last, out=self.n)

    def drop(self, lanes: np.ndarray | None, code: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The range of these lanes (None: all) after a symbol each; code is moved on. part and start are overwritten."""
        start *= part
        code -= start
        part *= size
        go = (part < LOW).nonzero()[0]
        if len(go):
            at = go if lanes is None else lanes.take(go)
            n, own = self.n.take(at), code.take(go)
            own <<= PIECE
            own |= self.data.take(n).astype(np.uint64)
            code[go] = own
            n += 1
            self.n[at] = n  # a lane that is through reads on without effect
            part[go] <<= PIECE
        return part


def splits(model: Guesses, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ids (a step a row) neither guess foretold, and start << 16 | size of the first symbol of each. As all ids are
    known, only guesses and parts are followed step by step; the rest is done for all steps at once."""
    steps, lanes = ids.shape
    last = np.concatenate([model.last[None], ids[:-1]])
    older = np.concatenate([model.older[None], last[:-1] * FACTORS[1, 0]]) if steps > 1 else model.older[None]
    fresh, slots = ids << 2, np.empty((steps, 2, lanes), np.int64)
    slots[:, 1] = last * FACTORS[1, 0]
    model.last, model.older = ids[-1].astype(np.int64), slots[-1, 1].copy()
    slots[:, 1] >>= 3
    slots[:, 0] = last * FACTORS[0, 0]
    slots[:, 0] += older
    slots &= SLOTS - 1
    slots += model.at
    entries, off = np.empty((steps, 2, lanes), np.int32), np.empty((steps, 2, lanes), np.int32)
    for slot, entry, x, differs in zip(slots, entries, fresh, off, strict=True):
        entry[:] = model.guess.take(slot)
        differs[:] = guess_again(model.guess, slot, entry, x)
    same = (entries[:, 0] ^ entries[:, 1]) < 4
    right2, right1 = off[:, 0] < 4, off[:, 1] < 4
    entries &= 3
    k = entries[:, 0] * 8 + entries[:, 1] * 2 + same
    slots[:] = k[:, None]
    slots += model.at32
    missed = ~(right2 | right1)
    outcome = np.where(right2, 0, 2 - right1)
    goals = GOALS_OF.take((outcome * 2 + same)[:, None] + ORDER1)
    parts = off  # written over
    for k, goal, n in zip(slots, goals, parts, strict=True):
        own = model.part.take(k)
        n[:] = own
        model.part[k] = towards(goal, own)
    first, second = parts[:, 0], parts[:, 1]
    upto = first + second
    start, size = np.where(right2, 0, np.where(missed, upto, first)), np.where(right2, first, np.where(missed, TOTAL - upto, second))
    return missed, (start << 16 | size).astype(np.uint32)


def pack(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids below 65536 as a frame: magic, number of ids, crc32, body."""
    out: list[bytes] = []
    for first in range(0, len(blocks), LANES):
        part = blocks[first : first + LANES]
        if any(b.max(initial=0) >= DIGITS.shape[1] for b in part):
            raise ValueError(f"ids of {DIGITS.shape[1]:,} and more can't be coded")
        longest, lanes = max(map(len, part)), len(part)
        ids = np.full((longest, lanes), END_ID, np.int32)
        for lane, block in enumerate(part):
            ids[: len(block), lane] = block
        model, digits, to = Guesses(lanes), Digits(lanes), Writer(lanes)
        for begin in range(0, longest, WINDOW):
            own = ids[begin : begin + WINDOW]
            missed, symbols = splits(model, own)
            # The symbols of a lane, in order: one for each id, three more behind a miss.
            before = np.cumsum(missed, 0, dtype=np.int32)
            place = (np.arange(len(own), dtype=np.int32)[:, None] + 3 * (before - missed)) * np.int32(lanes) + np.arange(lanes, dtype=np.int32)
            counts = len(own) + 3 * before[-1]
            stream = np.zeros((counts.max(), lanes), np.uint32)
            flat = stream.ravel()
            flat[place.ravel()] = symbols.ravel()
            rest = missed.ravel().nonzero()[0]
            if len(rest):
                at = place.ravel()[rest]
                for symbol in digits.symbols((rest % lanes).astype(np.int32), own.ravel()[rest]):
                    at += lanes
                    flat[at] = symbol
            to.put(stream, counts)
        out += [struct.pack("<4sII", MAGIC, len(b), zlib.crc32(b.astype("<u4").tobytes())) + row.tobytes() for b, row in zip(part, to.finish(), strict=True)]
    return out


def unpack(frames: list[bytes]) -> list[np.ndarray]:
    """The ids of each frame; ValueError where a frame is no frame or its checksum doesn't hold."""
    out: list[np.ndarray] = []
    for first in range(0, len(frames), LANES):
        part = frames[first : first + LANES]
        heads = [struct.unpack("<4sII", f[:12]) if len(f) >= 12 else (b"", 0, 0) for f in part]
        if any(h[0] != MAGIC or h[1] > BLOCK for h in heads):
            raise ValueError("not a block of token ids")
        longest = max(h[1] for h in heads)
        model, come = Models(len(part)), Reader([np.frombuffer(f[12 : 12 + (len(f) - 12) // 2 * 2], "<u2") for f in part])
        ids = np.zeros((longest, len(part)), np.int32)
        lanes, most = len(part), np.uint64(TOTAL - 1)
        everyone = np.arange(lanes)
        # Bounds of the outcomes' parts, and the guesses, a row for each outcome.
        bounds, guesses = np.zeros((4, lanes), np.int64), np.zeros((3, lanes), np.int64)
        bounds[3] = TOTAL
        bound, guess = bounds.view(np.uint64).ravel(), guesses.ravel()
        for step, row in enumerate(ids):
            if step % SLAB == 0:
                come.stay()
            model.split()
            bounds[1] = model.n[0]
            np.add(model.n[0], model.n[1], out=bounds[2])
            guesses[:2] = model.g
            share = come.range >> SHIFT
            at = np.minimum(come.code // share, most).view(np.int64)
            outcome = (at >= bounds[1]).astype(np.int64)
            outcome += at >= bounds[2]
            place = outcome * lanes
            place += everyone
            start, x = bound.take(place), guess.take(place)
            place += lanes
            come.range = come.drop(None, come.code, share, start, bound.take(place) - start)
            rest = (outcome == 2).nonzero()[0]
            if len(rest):
                code, rng, base, digits = come.code.take(rest), come.range.take(rest), model.base.take(rest), []
                for _ in range(3):
                    context = model.context(base, digits)
                    rows = model.look(context)
                    share = rng >> SHIFT
                    digit = (rows > np.minimum(code // share, most).astype(np.int16)[:, None]).argmax(1)
                    digit -= 1
                    start, size = model.span(digit)
                    rng = come.drop(rest, code, share, start.astype(np.uint64), size.astype(np.uint64))
                    model.adapt(context, rows, digit)
                    digits.append(digit)
                come.code[rest], come.range[rest] = code, rng
                x[rest] = (digits[0] * BASE + digits[1]) * BASE + digits[2]
            row[:] = x
            model.learn(x, outcome)
        for lane, (_, n, crc) in enumerate(heads):
            own = ids[:n, lane].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise ValueError("checksum of a block of token ids")
            out.append(own)
    return out


#: Pieces of text whose ids a Python worker keeps (twice as many at most), and characters encoded at once.
CACHE = 1 << 18
CHARS_A_CHUNK = 1 << 19
CHARS_A_FILE = 15_000_000
#: Files of a group whose lengths one task adds up.
FILES = 1024
FILE = "file_no int, block_no int, n_ids int, payload binary, doc_ids array<bigint>, doc_tokens array<int>"

#: Latin pieces without white space or combining marks: normalisation leaves them alone, and their lower case is told letter by letter.
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: Fixed value: how the vocabulary splits such a piece.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The characters that stand for bytes in the vocabulary; bytes that aren't printable have those from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHARACTER = {b: b for b in SHOWN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class Recent(dict):
    """Values found by `find`, of the last CACHE keys or more: when it is full, the entries so far become the older half."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        self[key] = found = self.find(key) if found is None else found
        return found


@lru_cache(2)
def _pieces(path: str) -> Recent:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model  # one call for each word; the whole tokenizer costs several times as much

    def word(text: str) -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(AS_CHARACTER)
        return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

    words = Recent(word)
    special = re.compile("|".join(re.escape(t.content.lower()) for t in tokenizer.get_added_tokens_decoder().values()) or "$^").search

    def piece(text: str) -> bytes:
        if PLAIN.fullmatch(text):
            lower = text.lower()
            if text.isalpha():
                return words[lower]
            if text[:-1].isalpha() and not text[-1].isalnum():
                return words[lower[:-1]] + words[lower[-1]]
            if not special(lower):
                return b"".join([words[w] for w in SPLIT.findall(lower)])
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    return Recent(piece)


def tokenise(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text (little-endian 32 bits) without special tokens.

    The vocabulary's rules never join across blanks or line feeds, so the library encodes the pieces between
    them, each distinct piece once while the bounded cache holds it.
    """
    find = _pieces(path).__getitem__
    return [b"".join(map(find, t.replace("\n", " ").split(" "))) for t in texts]


def write(docs: DataFrame, path: str, tokeniser: str, end_id: int = END_ID) -> None:
    """Token files of docs (doc_id, text) at path: END_ID after each document, ascending doc_id (nulls first, equal ids by text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(size // CHARS_A_FILE + 1, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches):
        from pyspark import TaskContext

        file_no, block_no = TaskContext.get().partitionId(), 0
        names, counts, ids, begun = [], [], [], []  # documents not written yet; ids not written yet; where documents begin
        held = 0

        def flush(last: bool):
            nonlocal held, block_no, ids, names, counts, begun
            whole, ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32), []
            take = len(whole) if last else LANES * BLOCK  # all lanes full: a turn costs as much with one
            blocks = [whole[a : a + BLOCK] for a in range(0, take, BLOCK)]
            if blocks:
                begins = np.array(begun, np.int64)
                bounds = np.searchsorted(begins, np.arange(0, take + BLOCK, BLOCK)[: len(blocks) + 1])
                if last:
                    bounds[-1] = len(begins)
                rows = [(file_no, block_no + i, len(b), f, names[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]) for i, (b, f) in enumerate(zip(blocks, pack(blocks), strict=True))]
                block_no += len(blocks)
                done = int(bounds[-1])
                names, counts, begun = names[done:], counts[done:], [b - take for b in begun[done:]]
                ids, held = [whole[take:]], len(whole) - take
                yield pa.RecordBatch.from_pydict(dict(zip(SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)), SCHEMA)

        for batch in batches:
            texts, docs_here = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            first = 0
            while first < len(texts):
                stop, chars = first, 0
                while stop < len(texts) and (stop == first or chars + len(texts[stop]) <= CHARS_A_CHUNK):
                    chars += len(texts[stop])
                    stop += 1
                for name, found in zip(docs_here[first:stop], tokenise(texts[first:stop], tokeniser), strict=True):
                    own_ids = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id))
                    names.append(name)
                    counts.append(len(own_ids))
                    begun.append(held)
                    ids.append(own_ids)
                    held += len(own_ids)
                first = stop
                while held >= LANES * BLOCK:
                    yield from flush(False)
        yield from flush(True)

    ordered.select("doc_id", "text").mapInArrow(encode, FILE).write.parquet(path)


SCHEMA = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32()))])


def read(files: DataFrame) -> DataFrame:
    """Documents of token files, in order: doc_id, file_no, place (in the file), start (over all files), ids_bytes, n_tokens.

    A file is at most about CHARS_A_FILE of text, so one task decodes it whole, all its blocks side by side.
    """
    def decode(group: pa.Table) -> pa.Table:
        group = group.sort_by("block_no")
        whole = np.concatenate(unpack(group.column("payload").to_pylist()))
        names = [x for own in group.column("doc_ids").to_pylist() for x in own]
        counts = np.array([x for own in group.column("doc_tokens").to_pylist() for x in own], np.int64)
        ends = np.cumsum(counts)
        n = len(names)
        return pa.table({"doc_id": pa.array(names, pa.int64()), "file_no": pa.array([group.column("file_no")[0].as_py()] * n, pa.int32()), "place": pa.array(ends - counts), "n_tokens": pa.array(counts),
                         "ids_bytes": pa.array([whole[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary())})

    docs = files.groupBy("file_no").applyInArrow(decode, "doc_id long, file_no int, place long, n_tokens long, ids_bytes binary")
    totals = files.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    # Ids in the files before, in two levels: within groups of FILES files, and over the groups.
    totals = totals.withColumn("g", F.floor(F.col("file_no") / FILES))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("g").agg(F.sum("n").alias("n")).select("g", earlier(Window.orderBy("g"), "n").alias("b"))
    before = totals.withColumn("w", earlier(Window.partitionBy("g").orderBy("file_no"), "n")).join(groups, "g").select("file_no", (F.col("w") + F.col("b")).alias("before"))
    return docs.join(small_side(before), "file_no").withColumn("start", F.col("before") + F.col("place")).drop("before")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids_bytes").alias("ids_crc32"))
