"""Signatures of texts, worked out over a batch with arrays."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# The signature's prime, factors and gram width.
PRIME, GRAM = (1 << 61) - 1, 8
FACTORS = [1, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]
TERMS = [41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89]
BLOCK = 1 << 15  # characters of texts that are worked on at a time, so that their arrays stay in the processor's cache
_P = np.uint64(PRIME)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to a gram's CRC-32 by its place from the gram's end, and what the number of bytes adds."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    tables, first, last = [x], [0], 0xFFFFFFFF
    for _ in range(4 * GRAM):
        last = int(x[last & 255]) ^ last >> 8
        first.append(last ^ 0xFFFFFFFF)
        tables.append(x[tables[-1] & np.uint32(255)] ^ (tables[-1] >> np.uint32(8)))
    return np.array(tables[: 4 * GRAM]), np.array(first, dtype=np.uint32)


_CRC, _CRC_FIRST = _crc_tables()
_CRC_PAIRS = [(_CRC[k - 1][:, None] ^ _CRC[k][None, :]).ravel() for k in range(GRAM - 1, 0, -2)]  # of two bytes, the second times 256


def _gram_hashes(text: str) -> np.ndarray:
    """CRC-32 and Adler-32 of the UTF-8 bytes of every gram of a text as one number, byte by byte over all grams at once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw) - GRAM + 1  # grams of one byte a character, which are all of most texts
    pairs = raw[1:].astype(np.intp)
    pairs <<= 8
    pairs |= raw[:-1]
    crc, a, b = np.full(n, _CRC_FIRST[GRAM]), np.ones(n, dtype=np.uint16), np.zeros(n, dtype=np.uint16)
    for k, table in enumerate(_CRC_PAIRS):
        crc ^= table.take(pairs[2 * k : 2 * k + n], mode="clip")
    for k in range(GRAM):
        a += raw[k : k + n]
        b += a
    if len(raw) > len(text):
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        ends = np.append(starts[GRAM:], len(raw))
        starts = starts[: len(ends)]
        sizes = ends - starts
        crc, a, b = crc[starts], a[starts].astype(np.uint32), b[starts].astype(np.uint32)
        wide = np.flatnonzero(sizes > GRAM)
        wide = wide[np.argsort(-sizes[wide], kind="stable")]  # so that those with a k-th byte are the first ones
        size, last = sizes[wide], ends[wide] - 1
        c, s, t = _CRC_FIRST[size], np.ones(len(wide), dtype=np.uint32), size.astype(np.uint32)
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, side="left"))
            byte = raw[last[:live] - k]
            c[:live] ^= _CRC[k][byte]
            s[:live] += byte
            t[:live] += byte * np.uint32(k + 1)
        crc[wide], a[wide], b[wide] = c, s, t % np.uint32(65521)  # s stays under it
    h = crc.astype(np.uint64)
    h <<= np.uint64(16)
    h |= b
    h <<= np.uint64(16)
    h |= a
    return _folded(h)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, which 2 ** 61 is one more than."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)  # what is less than the prime turns out greater by the subtraction


def _least(hashes: np.ndarray, spans: list[int]) -> np.ndarray:
    """By span, which begin and end at the given places, the last with the hashes, and by factor the least permuted hash."""
    steps = {gap: _folded(hashes * np.uint64(gap)) for gap in set(np.diff(FACTORS).tolist())}  # gaps are under 8, so within 64 bits
    x, spare = hashes.copy(), np.empty_like(hashes)
    out = np.empty((len(spans) // 2, len(FACTORS)), dtype=np.uint64)
    for i, (f, t) in enumerate(zip(FACTORS, TERMS, strict=True)):
        if i:
            x += steps[f - FACTORS[i - 1]]
            np.subtract(x, _P, out=spare)
            np.minimum(x, spare, out=x)
        carries = int(x.max()) + t >= PRIME
        out[:, i] = np.minimum.reduceat((x + np.uint64(t)) % _P if carries else x, spans[:-1])[::2]
        if not carries:
            out[:, i] += np.uint64(t)
    return out


def signatures(texts: Iterable[str | None]) -> list[list[int]]:
    """Twelve least permuted hashes of each text's character grams; zeros for a short text.

    Texts are joined to blocks, long ones cut, so that array operations are few; grams across two texts are passed over.
    """
    out, held, at, spans, size = [], [], [], [], 0

    def work() -> None:
        for i, row in zip(at, _least(_gram_hashes("".join(held)), spans).tolist(), strict=True):
            out[i] = row if out[i] is None else list(map(min, out[i], row))

    for i, text in enumerate(texts):
        bare = "".join((text or "").split()).lower()
        out.append([0] * len(FACTORS) if len(bare) < GRAM else None)
        for first in range(0, len(bare) - GRAM + 1, BLOCK):
            some = bare[first : first + BLOCK + GRAM - 1]
            if held and size + len(some) > BLOCK:
                work()
                held, at, spans, size = [], [], [], 0
            held.append(some)
            at.append(i)
            spans += [size, size + len(some) - GRAM + 1]
            size += len(some)
    if held:
        work()
    return out


def signature_of(text: str | None) -> list[int]:
    """One text's signature."""
    return signatures([text])[0]


@F.pandas_udf(ArrayType(LongType()))
def signature(texts: pd.Series) -> pd.Series:
    return pd.Series(signatures(texts), index=texts.index, dtype=object)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures; 0 if one is empty or they differ in length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(same / F.size(a))
