"""Masked CRC-32C of many byte strings at once.

The checksum is linear: the CRC of a string is the exclusive or of its 4-byte words, each moved on by the
bytes behind it. Words are therefore combined in pairs, pairs in fours and so on, for all strings of a
batch together; zero bytes put in front change nothing once the start value is folded into the first word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # CRC-32C (Castagnoli), reflected; fixed value
MASK_DELTA = 0xA282EAD8  # of the masked form; fixed value


def _tables(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Look-up tables of a linear map of 32 bits, for its lower and its upper 16 bits."""
    out = []
    for half in (columns[:16], columns[16:]):
        t = np.zeros(1, dtype=np.uint32)
        for c in half:
            t = np.concatenate([t, t ^ c])
        out.append(t)
    return out[0], out[1]


def _move(level: int, x: np.ndarray) -> np.ndarray:
    low, high = _level(level)
    return low[x & np.uint32(0xFFFF)] ^ high[x >> np.uint32(16)]


@lru_cache(maxsize=None)
def _level(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves a CRC on by 4 * 2**level zero bytes."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if level == 0:
        for _ in range(32):
            columns = np.where(columns & np.uint32(1), (columns >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), columns >> np.uint32(1))
    else:
        columns = _move(level - 1, _move(level - 1, columns))
    return _tables(columns)


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of each item, as uint32. Items of fewer than 4 bytes are not needed here and refused."""
    if any(len(x) < 4 for x in items):
        raise ValueError("items of 4 bytes or more")
    out = np.zeros(len(items), dtype=np.uint32)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        groups.setdefault(((len(x) + 3) // 4 - 1).bit_length(), []).append(i)
    for level, members in groups.items():
        width = 4 << level
        lot = max(1, (8 << 20) // width)
        for k in range(0, len(members), lot):
            some = members[k:k + lot]
            block = np.zeros((len(some), width), dtype=np.uint8)
            for r, i in enumerate(some):
                data = np.frombuffer(items[i], dtype=np.uint8)
                block[r, width - len(data):] = data
                block[r, width - len(data):width - len(data) + 4] ^= np.uint8(0xFF)
            v = block.view("<u4")
            for step in range(level):
                v = _move(step, v[:, 0::2]) ^ v[:, 1::2]
            out[some] = _move(0, v[:, 0]) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(items: list[bytes]) -> np.ndarray:
    crc = crc32c(items)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
