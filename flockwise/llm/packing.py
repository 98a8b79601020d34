"""Packing of token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.bpe import lettered
from flockwise.llm.common import slices, stored, text_or_empty
from flockwise.llm.pieces import Cache, encoded, word_lists

#: The letters and digits of Latin-1 as the word tokenizer's split pattern sees them.
L1 = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
N1 = "0-9²³¹¼-¾"
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L1}]+|[{N1}]|[^{L1}{N1}]+")
LATIN = re.compile("[\x21-\x7e\xa1-\xff]+")


class WordTokenizer:
    """The word tokenizer, with words encoded once; only words of Latin-1 letters take the short way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.parts = Cache(self._parts)
        self.cache = Cache(self._words)

    def _parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for part in parts:
            ids = [t.id for t in self.merge(lettered(part.encode()))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        split = [PRE.findall(w.lower()) if LATIN.fullmatch(w) and not any(s in w for s in self.special) else None for w in words]
        names = list({p for s in split if s for p in s})
        ids = dict(zip(names, self.parts.all(names), strict=True))
        out = []
        for word, parts in zip(words, split, strict=True):
            if parts is None:
                whole = self.tokenizer.encode(word, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(whole)}I", *whole))
            else:
                out.append(b"".join([ids[p] for p in parts]))
        return out


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    return WordTokenizer(path)


def tokenized(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of each row, with its place among the task's rows of that remainder and the task's full windows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_tokenizer(path), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        full = 0
        for batch in slices(batches, 1):
            ids, ends = encoded(word_lists(batch.column(1).cast(pa.string())), words.cache)
            kind = "<u2" if words.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
            raw, places, fulls = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                raw.append(np.append(ids[a:b], np.uint32(end_id)).astype(kind).tobytes())
                n = b - a + 1
                places.append(ranks[n % window])
                fulls.append(full)
                ranks[n % window] += 1
                full += n // window
            n = np.diff(ends) + 1
            rows = len(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(n % window), pa.array([part] * rows, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(fulls, pa.int64()), pa.array([int(kind[-1])] * rows, pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "n", "rest", "part", "place", "full", "width", "ids"],
            )

    schema = "doc_id long, n long, rest long, part long, place long, full long, width long, ids binary"
    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(run, schema)


def combinations(counts: dict[int, int], window: int, common: int = 64) -> list[tuple[int, ...]]:
    """Multisets of two lengths, and of three with two ``common`` ones, that fill ``window`` exactly."""
    out = {(a, window - a) for a in counts if 2 * a <= window and counts.get(window - a)}
    often = sorted(sorted(counts, key=lambda a: (-counts[a], a))[:common])
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - a - b
            if c > 0 and counts.get(c):
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 60) -> np.ndarray:
    """Non-negative repeat counts x of least squared error between combined lengths and ``counts``, by coordinate descent."""
    left = {a: float(n) for a, n in counts.items()}
    shape = [tuple(Counter(c).items()) for c in columns]
    norm = [sum(k * k for _, k in s) for s in shape]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, s in enumerate(shape):
            step = max(sum(k * left[a] for a, k in s) / norm[j], -x[j])
            if step:
                x[j] += step
                for a, k in s:
                    left[a] -= k * step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return x


class Plan:
    """Which rest goes where: ``slots[rest]`` lists (first place, per instance, sequence, offset); ``left`` what follows."""

    def __init__(self, counts: dict[int, int], window: int):
        counts = {int(a): int(n) for a, n in counts.items() if a}
        self.window = window
        columns = combinations(counts, window)
        wanted = np.floor(nnls(columns, counts) + 1e-6).astype(np.int64)
        have, taken = dict(counts), Counter()
        self.slots: dict[int, list[tuple[int, int, int, int, int]]] = {a: [] for a in counts}
        self.sequences = 0
        for greedy in (False, True):  # the rounded solution, then what residuals still allow
            for column, x in zip(columns, wanted.tolist(), strict=True):
                need = Counter(column)
                most = min(have[a] // k for a, k in need.items())
                times = most if greedy else min(x, most)
                if times <= 0:
                    continue
                offset = 0
                for a, k in sorted(need.items()):
                    self.slots[a].append((taken[a], times * k, k, self.sequences, offset))
                    taken[a] += times * k
                    have[a] -= times * k
                    offset += a * k
                self.sequences += times
        #: The rest is laid end to end by length and cut at window ends; the tail is cut at powers of two.
        self.first_left = {a: taken[a] for a in counts}
        at, self.base = 0, {}
        for a in sorted(have):
            self.base[a] = at
            at += a * have[a]
        self.tail = at - at % window
        ends, place = [], self.tail
        for bit in reversed(range(window.bit_length())):
            if (at - self.tail) >> bit & 1:
                place += 1 << bit
                ends.append(place)
        self.tail_ends = ends
        self.total = self.sequences + self.tail // window + len(ends)

    def pieces(self, rest: int, place: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document's rest, starts counted from the rest's own start."""
        if place < self.first_left[rest]:
            rows = self.slots[rest]
            lo, hi = 0, len(rows) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if rows[mid][0] <= place else (lo, mid - 1)
            first, _, k, sequence, offset = rows[lo]
            turn, slot = divmod(place - first, k)
            return [(0, rest, sequence + turn, offset + slot * rest)]
        at = self.base[rest] + rest * (place - self.first_left[rest])
        end, start, out = at + rest, at, []
        while start < end:
            if start < self.tail:
                number = start // self.window
                opened = number * self.window
                close = opened + self.window
            else:
                i = next(i for i, e in enumerate(self.tail_ends) if start < e)
                number, opened = self.tail // self.window + i, ([self.tail] + self.tail_ends)[i]
                close = self.tail_ends[i]
            stop = min(end, close)
            out.append((start - at, stop - start, self.sequences + number, start - opened))
            start = stop
        return out


def pack(
    docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all texts into sequences of at most ``window`` tokens; one row per piece.

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (binary,
    unsigned 32-bit little-endian).

    A document is cut into full windows, each a sequence, and a rest. The histogram of rests
    has at most ``window`` rows, so it alone goes to the driver. There combinations of two and
    three lengths that fill a window get repeat counts by non-negative least squares; these are
    rounded down, residual combinations are taken greedily, and what is left is laid end to end
    and cut. A rest is placed by its number among the rests of its length: its place in its
    task plus the earlier tasks' count, so that no length is ranked in one task. The last
    sequences are powers of two, so nothing is padded.

    A null text counts as empty and has one token, ``end_id``. Ids may be null and rows may
    repeat: each row is a document. An empty table gives an empty result. Other columns are ignored.
    """
    rows = stored(tokenized(docs, path, end_id, window, id_col, text_col), "tokens")
    light = rows.select("part", "rest", F.expr(f"n div {window}").alias("wins"))
    by_part = light.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("wins").alias("wins"))
    by_part = stored(by_part, "counts")
    totals = {r["rest"]: (r["n"], r["wins"]) for r in by_part.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins")).collect()}
    plan = Plan({a: n for a, (n, _) in totals.items()}, window)
    earlier = lambda w: F.coalesce(F.sum("x").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by_part.withColumn("x", F.col("n")).select("part", "rest", earlier(Window.partitionBy("rest")).alias("ahead"))
    wins = by_part.groupBy("part").agg(F.sum("wins").alias("x"))
    wins = wins.select("part", earlier(Window.partitionBy()).alias("full_ahead"))  # a row for each task of the scan
    shift = ranks.join(wins, "part")
    placed = rows.join(shift, ["part", "rest"]).select(
        "doc_id", "n", "rest", (F.col("place") + F.col("ahead")).alias("place"), (F.col("full") + F.col("full_ahead")).alias("full"), "width", "ids"
    )
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # at most a window's number of lengths and a few thousand combinations
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in slices(batches, 6):
            out: list[list] = [[] for _ in names]
            doc_ids, ns, rests, places, fulls, widths = (batch.column(i).to_pylist() for i in range(6))
            for i, raw in enumerate(batch.column(6)):
                data = np.frombuffer(raw.as_py(), f"<u{widths[i]}").astype("<u4").tobytes()
                whole, n = ns[i] // window, ns[i]
                cuts = [(w * window, window, plan.total + fulls[i] + w, 0) for w in range(whole)]
                if rests[i]:
                    cuts += [(whole * window + s, m, q, o) for s, m, q, o in plan.pieces(rests[i], places[i])]
                for start, length, sequence, offset in cuts:
                    piece = data[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_ids[i], start, length, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
