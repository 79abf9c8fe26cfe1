"""CRC-32C of many byte strings at once, and the masked form that record files keep."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
_BLOCK = 256


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


TABLE = _table()


def _advance_tables(size: int) -> list[list[int]]:
    """Four tables that move a remainder over ``size`` zero bytes, by its bytes."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(size):
        c = TABLE[c & 0xFF] ^ (c >> np.uint32(8))
    return c.tolist()


_ADVANCE = _advance_tables(_BLOCK)


def crc32c(parts: list[bytes]) -> list[int]:
    """Of each part. Bits are summed modulo two, so blocks are worked on side by side and then combined."""
    # leading zeros don't change a remainder that starts at zero; a start of ones is the first four bytes flipped
    long = [k for k, p in enumerate(parts) if len(p) >= 4]
    out = [_plain(p) if len(p) < 4 else 0 for p in parts]
    counts = [-(-len(parts[k]) // _BLOCK) for k in long]
    data = np.zeros(sum(counts) * _BLOCK, np.uint8)
    at = 0
    for k, count in zip(long, counts):
        at += count * _BLOCK
        start = at - len(parts[k])
        data[start:at] = np.frombuffer(parts[k], np.uint8)
        data[start : start + 4] ^= 0xFF
    c = np.zeros(sum(counts), np.uint32)
    for column in np.ascontiguousarray(data.reshape(-1, _BLOCK).T):
        c = TABLE[(c ^ column) & 0xFF] ^ (c >> np.uint32(8))
    blocks, at = c.tolist(), 0
    t0, t1, t2, t3 = _ADVANCE
    for k, count in zip(long, counts):
        total = 0
        for block in blocks[at : at + count]:
            total = t0[total & 0xFF] ^ t1[total >> 8 & 0xFF] ^ t2[total >> 16 & 0xFF] ^ t3[total >> 24] ^ block
        at += count
        out[k] = total ^ 0xFFFFFFFF
    return out


def _plain(part: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in part:
        c = int(TABLE[(c ^ byte) & 0xFF]) ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF
