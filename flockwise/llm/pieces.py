"""Encoding of whole record batches: split into pieces, encode each distinct piece once, gather ids."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flockwise.llm.common import offsets_of

#: Entries that a cache of a worker process may hold before it starts again.
CACHE_ROWS = 400_000


class Cache(dict):
    """Piece to ids (unsigned 32-bit, little-endian); ``encode`` fills what is missing."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.encode = encode

    def all(self, pieces: list[str]) -> list[bytes]:
        missing = [p for p in pieces if p not in self]
        if missing:
            if len(self) + len(missing) > CACHE_ROWS:
                self.clear()
                missing = pieces
            self.update(zip(missing, self.encode(missing), strict=True))
        return [self[p] for p in pieces]


def gather(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the runs ``codes`` in order, and the running total of their sizes (from 0)."""
    n = sizes[codes]
    total = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(starts[codes] - total[:-1], n) + np.arange(total[-1]), total


def encoded(lists: pa.ListArray, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and the offset at which each list starts (one more at the end)."""
    ends = offsets_of(lists)
    words = lists.flatten().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    found = cache.all(words.dictionary.to_pylist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4")
    places, total = gather(np.cumsum(sizes) - sizes, sizes, words.indices.to_numpy())
    return flat[places], total[ends - ends[0]]


#: The white space of the split pattern (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that isn't single between two other characters, or the mark used below.
ODD = f"[{SPACE}] | [{SPACE}]|\\A | \\z|\\x00"


def spaced_lists(texts: pa.StringArray) -> list[tuple[np.ndarray, pa.ListArray]]:
    """Row numbers with their pieces, which start with their space if they have one.

    A single space between two other characters always starts a match of the split pattern,
    so cutting there changes nothing. Texts with other spaces are cut by ``CHUNK``.
    """
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
    out = []
    if not odd.all():
        rows = np.flatnonzero(~odd)
        plain = texts.take(pa.array(rows))
        out.append((rows, pc.split_pattern(pc.replace_substring(plain, " ", "\x00 "), "\x00")))
    if odd.any():
        rows = np.flatnonzero(odd)
        out.append((rows, pa.array([CHUNK.findall(t) for t in texts.take(pa.array(rows)).to_pylist()], pa.list_(pa.string()))))
    return out


def word_lists(texts: pa.StringArray) -> pa.ListArray:
    """Words between ASCII white space; texts of Latin-1 characters in lower case, where lowering is per character."""
    wide = pc.match_substring_regex(texts, r"[^\x00-\x{ff}]")
    return pc.ascii_split_whitespace(pc.if_else(wide, texts, pc.utf8_lower(texts)))
