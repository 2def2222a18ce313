"""The writer of token files against a plain coder that goes through a block id by id."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tickweave.llm import range_coder
from tickweave.llm.range_coder import BASE, LEAST_DIGIT, LEAST_GUESS, MAGIC, TOTAL


def plain(ids: list[int], longest: int) -> bytes:
    """The frame of one block, padded to the longest of those beside it."""
    guess2, guess1, parts, rows = {}, {}, {}, {}
    low, rng, pieces = 0, 1 << 48, []
    older = last = 0

    def put(start, size):
        nonlocal low, rng
        part = rng >> 14
        low, rng = low + part * start, part * size
        if rng < 1 << 32:
            pieces.append(low >> 32)
            low, rng = (low & 0xFFFFFFFF) << 16, rng << 16

    for x in [*ids, *[1] * (longest - len(ids))]:
        s2, s1 = (older + last * 30011) % 4096, (last * 40503 >> 3) % 4096
        (g2, sure2), (g1, sure1) = guess2.get(s2, (0, 0)), guess1.get(s1, (0, 0))
        same = g2 == g1
        k = (sure2, sure1, same)
        n2, n1 = parts.get(k, (TOTAL // 4, 0 if same else TOTAL // 8))
        most = TOTAL - TOTAL // 64 - LEAST_GUESS
        if x == g2:
            put(0, n2)
            goal2, goal1 = most, LEAST_GUESS
        elif x == g1:
            put(n2, n1)
            goal2, goal1 = LEAST_GUESS, most
        else:
            put(n2 + n1, TOTAL - n2 - n1)
            goal2, goal1 = LEAST_GUESS, LEAST_GUESS
            a, b, c = x // BASE**2, x // BASE % BASE, x % BASE
            for context, d in ((0, a), (1 + a, b), (42 + (a * BASE + b) * 37 % 256, c)):
                row = rows.setdefault(context, np.linspace(0, TOTAL, BASE + 1).astype(int).tolist())
                put(row[d], row[d + 1] - row[d])
                rows[context] = [v + ((i * LEAST_DIGIT + (TOTAL - BASE * LEAST_DIGIT) * (i > d) - v) >> 4) for i, v in enumerate(row)]
        if same:
            goal2, goal1 = most if x == g2 else LEAST_GUESS, 0
        parts[k] = n2 + ((goal2 - n2) >> 4), n1 + ((goal1 - n1) >> 4)
        for table, slot, g, sure in ((guess2, s2, g2, sure2), (guess1, s1, g1, sure1)):
            table[slot] = (g, min(sure + 1, 3)) if g == x else (g, 1) if sure > 1 else (x, 0)
        older, last = last * 40503, x
    for _ in range(3):
        pieces.append(low >> 32)
        low = (low & 0xFFFFFFFF) << 16
    for k in range(len(pieces) - 1, 0, -1):
        pieces[k - 1] += pieces[k] >> 16
        pieces[k] &= 0xFFFF
    return struct.pack("<4sII", MAGIC, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) + np.array(pieces, "<u2").tobytes()


def blocks_of_many_kinds() -> list[np.ndarray]:
    rng = np.random.default_rng(8)
    kinds = [rng.zipf(1.3, 1400) % 49152, np.tile([5, 6, 7, 5, 6, 8], 200), rng.integers(0, 65536, 700), rng.choice([0, 1680, 1681, 65535], 900), np.full(600, 1), [], [65535]]
    return [np.array(k, np.uint32) for k in kinds] + [(rng.zipf(1.5, 300) % 65536).astype(np.uint32) for _ in range(140)]


def test_frames_are_those_of_a_plain_coder():
    """Over several windows, more lanes than are sorted at once, lanes of different length."""
    blocks = blocks_of_many_kinds()
    frames = range_coder.pack(blocks)
    for k in [*range(9), 127, 128, 129, 146]:
        assert frames[k] == plain(blocks[k].tolist(), 1400), k
    assert all((a == b).all() for a, b in zip(range_coder.unpack(frames), blocks, strict=True))


def test_the_writer_takes_all_rows_of_a_window_at_once(monkeypatch):
    """Rows of frequencies are neither looked up nor put back id by id: that is for the reader, which doesn't know what comes."""
    blocks = blocks_of_many_kinds()
    frames = range_coder.pack(blocks)

    def step(*_):
        raise AssertionError("a row at a step")

    for name in ("look", "adapt"):
        monkeypatch.setattr(range_coder.Models, name, step)
    assert range_coder.pack(blocks) == frames
