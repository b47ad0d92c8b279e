"""Hashes of words, word n-grams and bytes as numpy arrays, the same in every process."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word (x is changed in place)."""
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word from two 32-bit checksums."""
    low = np.fromiter(map(crc32, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.uint64, len(words))
    return mix64((low << np.uint64(20)) + size + _ODD)


def windows_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values; none if there are fewer."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _ODD
        out += hashes[k : k + count]
    return mix64(out)


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of consecutive equal keys over a stream of frames sorted by them; a group may span frames."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for frame in frames:
        if frame.empty:
            continue
        changed = np.zeros(len(frame), bool)
        for k in keys:
            column = frame[k].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed).tolist()
        for a, b in zip([0, *starts], [*starts, len(frame)], strict=True):
            part = frame.iloc[a:b]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != held_key:
                yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            held_key = key
    if held:
        yield held_key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
