"""N-gram Jaccard join by vertical partitioning, with linked groups as components."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.common import components, discard, offsets_of, slices, stored, text_or_empty

U = np.uint64
#: Ratio between the set sizes that bound a class.
STEP = 1.5
#: Signatures and shingles are shuffled in so many turns (by the remainder of the signature or of the fragment's number), each stored before the next.
TURNS = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.StringArray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; lower case A-Z, words between ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = offsets_of(lists)
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), U, len(names))
    real = np.array([w != "" for w in names], bool) if names else np.empty(0, bool)
    codes = flat.indices.to_numpy()
    keep = real[codes]
    ends = np.concatenate(([0], np.cumsum(keep)))[ends - ends[0]]
    h = hashes[codes[keep]]
    total = max(len(h) - words + 1, 0)
    rolled = np.zeros(total, U)
    for j in range(words):
        rolled = rolled * U(0x9E3779B97F4A7C15) + mixed(h[j : j + total] + U(j + 1))
    rolled = mixed(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:  # a shorter text is one shingle, marked by its length
            whole = np.array([b - a], U)
            for i in range(a, b):
                whole = mixed(whole * U(0xD6E8FEB86659FD93) + h[i])
            out.append(whole)
        else:
            out.append(np.empty(0, U))
    return out


class Cuts:
    """The class of each set size and how many fragments of the hash order tell its sets apart.

    Sets x, y with 100 * |x & y| >= percent * |x | y| differ in at most (|x|+|y|)(100-percent)/(100+percent)
    shingles. Each spoils one fragment, so if a set has more non-empty fragments than that, one
    of them is equal in both. A pair meets in the class of its larger set.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.known: dict[int, int] = {}

    def number(self, size: int) -> int:
        return int(math.log(size) / math.log(STEP) + 1e-9)

    def classes(self, size: int) -> range:
        return range(self.number(size), self.number(max(size * 100 // self.percent, size)) + 1)

    def spoiled(self, number: int) -> int:
        largest = math.ceil(STEP ** (number + 1) + 1e-6)
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    def fragments(self, number: int) -> int:
        if number not in self.known:
            self.known[number] = self._fragments(number)
        return self.known[number]

    def _fragments(self, number: int) -> int:
        """Enough that few sets have more empty fragments than are to spare."""
        need, least = self.spoiled(number) + 1, max(1, self.percent * int(STEP**number) // 100)
        m = need
        while True:
            empty = m * math.exp(-least / m) if need > 1 else 0
            if m - empty - 3 * math.sqrt(empty) >= need or m >= 2 * need + 2:
                return m
            m += 1

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """A hash of each non-empty fragment of ``s`` with its number and class; one more where too few are non-empty."""
        out = []
        for c in self.classes(len(s)) if len(s) else ():
            if not self.spoiled(c):
                continue  # only equal sets link, and these are one set already
            m = self.fragments(c)
            part = ((s >> U(32)) * U(m)) >> U(32)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mixed(s + U(1)), starts)
            out.append(mixed(sums + mixed(part[starts] * U(1 << 20) + U(c) + U(1 << 52))))
            if len(starts) <= self.spoiled(c):
                out.append(mixed(np.array([(1 << 60) + c], U)))
        return np.concatenate(out) if out else np.empty(0, U)


def _keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
    return [int(m[0]) for m in marks], [int(m[1]) for m in marks]


def _signer(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, row = Cuts(percent), TaskContext.get().partitionId() << 33
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1).cast(pa.string()), words)
            k1, k2 = _keys(sets)
            signed = []
            for s, key in zip(sets, zip(k1, k2, strict=True), strict=True):
                signed.append(np.empty(0, np.int64) if key in seen else cuts.signatures(s).view(np.int64))
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(key)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in signed])))
            sigs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signed) if signed else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(sets)), pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), sigs],
                ["row", "doc_id", "n", "k1", "k2", "sigs"],
            )
            row += len(sets)

    return run


def _segmenter(words: int, parts: int):
    """Sets cut into ``parts`` ranges of the hash order, one row per non-empty fragment. A task leaves out copies of sets it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, 0):
            sets = shingle_sets(batch.column(0).cast(pa.string()), words)
            k1, k2 = _keys(sets)
            rows: list[tuple] = []
            for a, b, s in zip(k1, k2, sets, strict=True):
                if (a, b) in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add((a, b))
                part = ((s >> U(32)) * U(parts)) >> U(32)
                for p in np.unique(part).tolist():
                    rows.append((a, b, p, s[part == p].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["k1", "k2", "part", "segment"]
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition whose signature a neighbour shares, and those at its ends, whose neighbours are elsewhere."""
    held: pa.RecordBatch | None = None
    first = True
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        sig = batch.column(0).to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if first:
            keep[0] = True
        # the last row waits for the next batch; the one before goes along so that its neighbour is known
        tail = min(2, len(sig))
        emit = keep.copy()
        emit[len(sig) - 1] = False
        if held is not None:
            emit[: held.num_rows - 1] = False
        yield batch.filter(pa.array(emit))
        held = batch.slice(len(sig) - tail)
        first = first and len(sig) == 1
    if held is not None:
        yield held.slice(held.num_rows - 1)


def verified(pairs: DataFrame, segments: DataFrame, parts: int, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b with sizes and set keys) that link: overlaps counted per fragment, then summed per pair."""
    pair = ["a", "b", "na", "nb"]
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    left = segments.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "part", F.col("segment").alias("left"))
    right = segments.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "part", F.col("segment").alias("right"))
    met = each.join(left, ["a1", "a2", "part"]).join(right, ["b1", "b2", "part"])
    counts = met.select(*pair, F.size(F.array_intersect("left", "right")).cast("long").alias("x"))
    return counts.groupBy(*pair).agg(F.sum("x").alias("both")).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def prefixed(left: DataFrame, names: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Rarest shingles of the sets in ``left`` (node, comp): node, comp, n, free, t, place.

    A set of n shingles shares at least percent * n / 100 with any set it links to. So of its shingles in any common order, the first
    n - that number + 1 hold one that both have among their first. The order is by holders, then hash.
    """
    sets = names.join(left.select("node", "comp").distinct(), "node")
    held = sets.join(segments, ["k1", "k2"]).select("node", "comp", "n", "free", F.explode("segment").alias("t"))
    holders = held.groupBy("t").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    first = Window.partitionBy("node").orderBy("c", "t")
    least = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    ranked = held.join(holders, "t").withColumn("place", F.row_number().over(first)).where(F.col("place") <= F.col("n") - least + 1)
    return ranked.where("lo <> hi").select("node", "comp", "n", "free", "t", "place")


def jaccard_components(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", parts: int = 8, rounds: int = 3
) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable).

    The global order of n-grams is that of their 64-bit hashes. Signatures are hashes of whole
    fragments of that order, fine enough that linked sets must agree on one; sets that agree
    are candidates. For these the order is cut into ``parts`` coarse fragments, overlaps are counted
    in each fragment by itself, and summed per pair.

    Equal sets are folded first. Of the candidates that share a signature, ``rounds`` rounds
    check all against one leader, and only between groups that aren't linked yet. The last round
    finds what still can link by prefixes, see ``prefixed``: shingles of few holders come first, so copies
    that differ by edits of their own never meet. A pair is left out only if its overlap can't
    reach the bound: by sizes, by the shingles that no other candidate has, or as its prefixes share
    none. So a large group of copies costs few pairs, and no link is lost. Signatures are sorted by
    range, which splits a frequent one over tasks. Signatures and the search for shingles of no other candidate
    are shuffled in ``TURNS`` turns, and written tables are deleted once they are superseded.

    Hash collisions of 64 bits could add a wrong shingle to an overlap; sets are told apart by 128 bits.
    Null and empty texts and texts without words have no shingles and link with nothing: their
    component is their own id. Rows with a null id link nothing and get a null component.
    Rows that repeat an id with other texts each link by their own text; the component id counts
    them all. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = stored(rows.mapInArrow(_signer(words, percent), "row long, doc_id long, n long, k1 long, k2 long, sigs array<long>"), "signed")
    sets = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.lit(1).alias("one")).drop("one")
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    of_row = stored(signed.select("row", "doc_id", "n", "k1", "k2").join(sets.select("k1", "k2", "n", "node"), ["k1", "k2", "n"], "left").select("row", "doc_id", "n", "node"), "rows")
    turns_met = []
    for turn in range(TURNS):
        met = signed.select(F.explode(F.filter("sigs", lambda s: F.pmod(s, F.lit(TURNS)) == turn)).alias("sig"), "row")
        met = met.repartitionByRange("sig", "row").sortWithinPartitions("sig", "row").mapInArrow(_runs, "sig long, row long")
        met = met.join(of_row.where("node IS NOT NULL").select("row", "node"), "row").groupBy("sig", "node").agg(F.lit(1).alias("one")).drop("one")
        turns_met.append(stored(met, "met"))
    groups = functools.reduce(DataFrame.unionByName, turns_met)
    many = groups.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig")
    discard(signed)
    groups = stored(groups.join(many, "sig", "left_semi").withColumn("comp", F.col("node")), "groups")
    discard(*turns_met)
    wanted = sets.join(groups.select("node").distinct(), "node", "left_semi")
    segments = rows.select("text").mapInArrow(_segmenter(words, parts), "k1 long, k2 long, part long, segment array<long>")
    segments = stored(segments.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2", "part"]), "segments")
    # shingles of no other candidate can't be shared: what remains bounds any overlap of the set
    turns_alone = []
    for turn in range(TURNS):
        alone = segments.where(F.col("part") % TURNS == turn).select("k1", "k2", F.explode("segment").alias("t"))
        alone = alone.groupBy("t").agg(F.count("*").alias("c"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
        turns_alone.append(stored(alone.where("c = 1").groupBy("k1", "k2").agg(F.count("*").alias("alone")), "alone"))
    alone = functools.reduce(DataFrame.unionByName, turns_alone).groupBy("k1", "k2").agg(F.sum("alone").alias("alone"))
    names = wanted.select("node", "n", "k1", "k2").join(alone, ["k1", "k2"], "left").withColumn("free", F.col("n") - F.coalesce("alone", F.lit(0)))
    names = stored(names.where(f"100 * free >= {percent} * n").select("node", "n", "free", "k1", "k2"), "names")
    found, groups = groups, stored(groups.join(names.select("node", "n", "free"), "node"), "groups")
    whole_segments, segments = segments, stored(segments.join(names.select("k1", "k2"), ["k1", "k2"], "left_semi"), "segments")
    discard(found, whole_segments, sets, *turns_alone)
    comp = stored(names.select("node", F.col("node").alias("comp")), "comp")
    can = lambda na, nb, fa, fb: f"{100 + percent} * least({fa}, {fb}) >= {percent} * ({na} + {nb})"
    done, before, checked = None, groups, []
    for turn in range(rounds + 1):
        # the first leader is a set with fewest shingles of its own: what the others are copies of
        own = F.col("n") - F.col("free") if turn == 0 else F.lit(0).cast("long")
        key = F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp", "n", "free")
        heads = groups.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(key).alias("head")).where("lo <> hi")
        heads = heads.select("sig", F.col("head.node").alias("x"), F.col("head.comp").alias("cx"), F.col("head.n").alias("nx"), F.col("head.free").alias("fx"))
        last, groups = before, stored(groups.join(heads, "sig"), "groups")
        discard(last)
        before = groups
        if groups.isEmpty():
            break
        if turn < rounds:
            pairs = groups.where("comp <> cx").where(can("n", "nx", "free", "fx")).select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
        else:
            prefix = stored(prefixed(groups, names, segments, percent), "prefix")
            one = prefix.select("t", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("free").alias("fa"), F.col("place").alias("pa"))
            other = prefix.select("t", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("free").alias("fb"), F.col("place").alias("pb"))
            # where two sets first meet in the order, all that they share is this shingle and what comes after it in either
            rest = f"{100 + percent} * (1 + least(na - pa, nb - pb)) >= {percent} * (na + nb)"
            near = F.expr(f"a < b AND ca <> cb AND {can('na', 'nb', 'fa', 'fb')} AND {rest} AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
            pairs = one.alias("l").join(other.alias("r"), (F.col("l.t") == F.col("r.t")) & near).select("a", "b")
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        side = lambda c: names.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        pairs = stored(pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"), "pairs")
        links = stored(verified(pairs, segments, parts, percent), "links")
        checked.append(pairs)
        done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
        at = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        joined = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = joined.select(F.col("node").alias("comp"), F.col("component").alias("now"))
        old, comp = comp, stored(comp.join(joined, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "comp")
        discard(old, links)
        groups = groups.select("sig", "node", "n", "free").join(comp, "node")
    discard(before, segments, names, *checked)
    whole = of_row.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = whole.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = whole.join(least, "comp", "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"))
