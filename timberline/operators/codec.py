"""Integer and string codecs, as SQL expressions and as vectorised encoders of whole streams.

Z: the count, then each value zigzag-coded, as varints (7 bits a byte, least first, high bit: more follow). NE: decimal
text, one value a line. P: the count, the number of negatives, (place, magnitude) of each, then the other values, as
varints. Strings: a dictionary of first-seen values and ordinals, or the values' lengths and bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("bigint"))))


def varint_length(z: Column) -> Column:
    """Bytes of a non-negative value."""
    out = F.when(z < (1 << 7), 1)
    for k in range(2, 9):
        out = out.when(z < (1 << 7 * k), k)
    return out.otherwise(9)


def varint_hex(z: Column) -> Column:
    """The bytes of a non-negative value as upper-case hexadecimal digits."""
    n = varint_length(z)
    byte = lambda i: F.shiftrightunsigned(z, 0) if i == 0 else F.shiftrightunsigned(z, 7 * i)
    return F.concat(*[F.when(n > i, F.lpad(F.hex(byte(i).bitwiseAND(F.lit(127)) + F.when(n > i + 1, 128).otherwise(0)), 2, "0")).otherwise("") for i in range(9)])


def zigzag_np(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def unzigzag_np(z: np.ndarray) -> np.ndarray:
    return (z >> np.uint64(1)).astype(np.int64) ^ -((z & np.uint64(1)).astype(np.int64))


def varints(z: np.ndarray) -> bytes:
    """All values as varints, without a loop over values."""
    z = z.astype(np.uint64)
    if not len(z):
        return b""
    n = np.ones(len(z), dtype=np.int64)
    for k in range(1, 10):
        n += z >= np.uint64(1 << 7 * k)
    out = np.zeros((len(z), 10), dtype=np.uint8)
    for k in range(10):
        out[:, k] = ((z >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n > k + 1) * 128).astype(np.uint8)
    return out[np.arange(10)[None, :] < n[:, None]].tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def encode_ints(v: np.ndarray, codec: str, delta: bool) -> bytes:
    v = np.asarray(v, dtype=np.int64)
    if delta and len(v):
        v = np.diff(v, prepend=0)
    if codec == "NE":
        return "\n".join(map(str, v.tolist())).encode()
    if codec == "P":
        low = np.flatnonzero(v < 0)
        pairs = np.stack([low, -v[low]], axis=1).ravel() if len(low) else np.empty(0, dtype=np.int64)
        return varints(np.concatenate([[len(v), len(low)], pairs, v[v >= 0]]))
    return varints(np.concatenate([np.array([len(v)], dtype=np.uint64), zigzag_np(v)]))


def decode_ints(data: bytes, codec: str, delta: bool) -> np.ndarray:
    if codec == "NE":
        v = np.array([int(x) for x in data.decode().split("\n")] if data else [], dtype=np.int64)
    else:
        z = unvarints(data)
        if codec == "P":
            n, k = int(z[0]), int(z[1])
            pairs = z[2 : 2 + 2 * k].astype(np.int64).reshape(-1, 2)
            v, high = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
            v[pairs[:, 0]], high[pairs[:, 0]] = -pairs[:, 1], False
            v[high] = z[2 + 2 * k :].astype(np.int64)
        else:
            v = unzigzag_np(z[1:])
    return np.cumsum(v) if delta else v


def encode_strings(values: list[str]) -> bytes:
    """A dictionary where it is smaller, else plain: a first byte D or S, then lengths as varints and Latin-1 or UTF-8 bytes."""
    place: dict[str, int] = {}
    ids = [place.setdefault(v, len(place)) for v in values]
    plain = _strings(values)
    coded = varints(np.array([len(place)], dtype=np.uint64)) + _strings(list(place)) + varints(np.array(ids, dtype=np.uint64))
    return b"D" + coded if len(coded) < len(plain) else b"S" + plain


def _strings(values: list[str]) -> bytes:
    raw = [v.encode("utf-8", "surrogatepass") for v in values]
    return varints(np.array([len(values), *map(len, raw)], dtype=np.uint64)) + b"".join(raw)


def _take_varints(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    if not n:
        return np.empty(0, dtype=np.uint64), at
    window = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(len(data) - at, 10 * n))
    end = int(np.flatnonzero(window < 128)[n - 1]) + 1
    return unvarints(window[:end].tobytes()), at + end


def _take_strings(data: bytes, at: int) -> tuple[list[str], int]:
    (n,), at = _take_varints(data, at, 1)
    sizes, at = _take_varints(data, at, int(n))
    out = []
    for size in sizes.tolist():
        out.append(data[at : at + size].decode("utf-8", "surrogatepass"))
        at += size
    return out, at


def decode_strings(data: bytes) -> list[str]:
    if data[:1] == b"S":
        return _take_strings(data, 1)[0]
    _, at = _take_varints(data, 1, 1)
    values, at = _take_strings(data, at)
    return [values[i] for i in unvarints(data[at:]).tolist()]
