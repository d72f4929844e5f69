"""Words of whole Arrow columns of text as 64-bit hashes, without a Python object a word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are hashed in steps of eight for all words at once; longer words are hashed one by one.
LONGEST = 64
#: All bits of the first k bytes of a number, the first byte lowest.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(29))


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of `a` followed by `b`."""
    return mixed(mixed((a + MIX[2]) * MIX[0]) + b)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of all words of `texts`, one text after the other, and how many each text has; a null text has none.

    Words are runs of anything but the six ASCII white-space characters, with A-Z lower-cased, in UTF-8.
    """
    # a white-space byte after each text, so that no word goes on in the next
    data = b"\n".join((*(t.as_buffer() if t.is_valid else b"" for t in texts), b"")).lower()
    ends = np.cumsum([(t.as_buffer().size if t.is_valid else 0) + 1 for t in texts]).astype(np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[0::2], edge[1::2]
    sizes = np.diff(np.searchsorted(start, ends), prepend=0)
    left = stop - start
    eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    out = mixed(left.astype(np.uint64) * MIX[0])
    at = np.flatnonzero(left <= LONGEST)
    done = 0
    while len(at):
        part = eights[start[at] + done] & _KEEP[np.minimum(left[at] - done, 8)]
        out[at] = mixed((out[at] ^ part) * MIX[0])
        done += 8
        at = at[left[at] > done]
    for i in np.flatnonzero(left > LONGEST):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]], digest_size=8).digest(), "little")
    return out, sizes
