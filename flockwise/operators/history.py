"""History of each event in decayed form, for one long stream or many short ones.

Events are laid out once in the total order ``(fit_id, t, actor, mark, event_id)`` and cut
into chunks of a fixed number of rows, whatever the sizes of the fits: a hot fit spans many
chunks, small fits share one. A pass over the events then runs per chunk. What a chunk must
know about the past is a small state (three decayed sums per source); it is built for every
chunk in parallel and carried forward by a segmented scan whose groups have bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.operators.intervals import interval_index
from flockwise.session import cut_lineage

FAN = 1024
MAX_EXPONENT = 300.0
EPS = 1e-9


@dataclass
class Layout:
    """Ordered, chunked events and the shape of their model."""

    events: DataFrame  # fit_id, chunk, pos, event_id, t, actor, mark, b, t_end, cut (its fit spans chunks)
    cells: DataFrame  # chunk, fit_id, b
    fits: DataFrame  # chunk, fit_id, cut
    n_chunks: int
    n_fits: int
    spans: bool  # some fit is larger than a chunk, so state must be carried
    K: int
    M: int
    dt: float
    horizon: float
    outside: DataFrame | None = None  # events that the window or the model leaves out

    def dropped(self) -> DataFrame:
        """How many events of each fit were left out: ``fit_id, n_dropped``."""
        return self.outside.groupBy("fit_id").agg(F.count(F.lit(1)).alias("n_dropped"))

    @property
    def B(self) -> int:
        return int(np.ceil(self.horizon / self.dt))

    def release(self) -> None:
        self.events.unpersist()
        self.cells.unpersist()
        self.fits.unpersist()


def layout(events: DataFrame, k: int, m: int, dt: float, horizon: float, chunk_rows: int | None = None, keep: tuple[str, ...] = ()) -> Layout:
    """Order and chunk events; rows outside the window or the model are left out and counted by ``Layout.dropped``.

    A fit that fits into a chunk is never cut; a larger one spans as many as it needs. By
    default chunks hold 1,024 to 16,384 rows, enough of them to occupy every core.
    """
    from flockwise.operators.events import in_domain

    spark = events.sparkSession
    order = ["fit_id", "t", "actor", "mark", "event_id"]
    inside = events.filter(in_domain(0.0, horizon, k, m)).select(*order, *keep)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = inside.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition number and row number are fixed in storage before anything refers to them
    placed = cut_lineage(ranged.select(
        "*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")
    ))
    # one count per partition, at most ``parts`` rows
    counts = {r["__pid"]: r["n"] for r in placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for pid in range(parts):
        offsets.append(total)
        total += counts.get(pid, 0)
    if chunk_rows is None:
        chunk_rows = int(min(16384, max(1024, total // (2 * parts))))
    start = F.array(*[F.lit(o).cast("long") for o in offsets])
    placed = placed.withColumn("pos", start[F.col("__pid")] + F.col("__row")).drop("__pid", "__row")
    sizes = placed.groupBy("fit_id").agg(F.min("pos").alias("__first"), F.count(F.lit(1)).alias("__size"))
    b = interval_index(F.col("t"), dt, F.lit(float(horizon)), "clip")
    anchor = F.when(F.col("__size") > chunk_rows, F.col("pos")).otherwise(F.col("__first"))
    out = (
        with_sizes(placed, sizes, chunk_rows)
        .withColumn("chunk", F.floor(anchor / chunk_rows).cast("long"))
        .withColumn("b", b)
        .withColumn("t_end", F.least((F.col("b") + 1) * F.lit(float(dt)), F.lit(float(horizon))))
        .withColumn("cut", F.col("__size") > chunk_rows)
        .drop("__first", "__size")
    )
    n_chunks = max(1, -(-total // chunk_rows))
    out = out.repartition(min(n_chunks, 4 * parts), "chunk").persist()
    cells = out.select("chunk", "fit_id", "b").distinct().persist()
    seen = sizes.agg(F.count(F.lit(1)).alias("fits"), F.max("__size").alias("largest")).first()
    spans = (seen["largest"] or 0) > chunk_rows
    fits = out.select("chunk", "fit_id", "cut").distinct().persist()
    return Layout(out, cells, fits, n_chunks, seen["fits"], spans, k, m, float(dt), float(horizon), events.filter(~in_domain(0.0, horizon, k, m)).select("fit_id"))


def with_sizes(placed: DataFrame, sizes: DataFrame, chunk_rows: int) -> DataFrame:
    """Each event with the first position and the size of its fit; rows meet by stretches of positions, so a large fit is not one key."""
    stretch = lambda pos: F.floor(pos / chunk_rows)
    first, last = F.col("__first"), F.col("__first") + F.col("__size") - 1
    touched = sizes.withColumn("__stretch", F.explode(F.sequence(stretch(first), stretch(last))))
    return placed.withColumn("__stretch", stretch(F.col("pos"))).join(touched, ["fit_id", "__stretch"]).drop("__stretch")


def parted(lay: Layout) -> tuple[Layout, Layout | None]:
    """The fits that lie whole in a chunk, and those that span chunks, if there are any."""
    if not lay.spans:
        return lay, None
    whole = replace(lay, events=lay.events.filter("NOT cut"), fits=lay.fits.filter("NOT cut"), spans=False)
    spanning = replace(lay, events=lay.events.filter("cut"), fits=lay.fits.filter("cut"))
    return tuple(replace(x, cells=lay.cells.join(x.fits.select("chunk", "fit_id"), ["chunk", "fit_id"], "left_semi")) for x in (whole, spanning))


# --- numpy inside a chunk ---------------------------------------------------------------


def decayed_prefix(t, src, amp, size, beta, state, t_state):
    """Before each event, ``Σ_earlier amp β e^{-β(t-t')}`` per source; and the final state.

    Sums run in growing exponentials that are rebased before ``β·span`` reaches the cap, so
    nothing overflows and all terms are positive.
    """
    n = len(t)
    out = np.empty((n, size))
    block = np.floor(beta * (t - t[0]) / MAX_EXPONENT)
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        tt = t[lo:hi]
        state = state * np.exp(-beta * (tt[0] - t_state))
        up = np.exp(beta * (tt - tt[0]))
        inc = np.zeros((hi - lo, size))
        inc[np.arange(hi - lo), src[lo:hi]] = amp[lo:hi] * beta * up
        cum = np.cumsum(inc, axis=0)
        out[lo] = state
        out[lo + 1 : hi] = (state + cum[:-1]) / up[1:, None]
        state, t_state = (state + cum[-1]) / up[-1], tt[-1]
    return out, state


class Segment:
    """The events of one fit inside one chunk, with the history carried into it."""

    def __init__(self, ev: dict, w, beta0: float, beta1: float, K: int, M: int, carry=None):
        t, b = ev["t"], ev["b"]
        src = ev["actor"] * M + ev["mark"]
        S = K * M
        zero = np.zeros(S)
        tau, last_b, last_w, r0, p0, q0 = (t[0], -1, 0.0, zero, zero, zero) if carry is None else carry
        one = np.ones(len(t))
        self.R, r_end = decayed_prefix(t, src, one, S, beta0, r0, tau)
        self.P, p_end = decayed_prefix(t, src, w, S, beta1, p0, tau)
        U, _ = decayed_prefix(t, src, one, S, beta1, zero, t[0])
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        first = np.repeat(head, np.diff(np.r_[head, len(t)]))
        fade = np.exp(-beta1 * (t - t[first]))[:, None]
        base = self.P[first]
        self.same = U - U[first] * fade
        # sources with no event in the interval yet are exactly zero, not a rounding rest
        hits = np.zeros((len(t), S), dtype=np.int32)
        hits[np.arange(len(t)), src] = 1
        hits = np.cumsum(hits, axis=0) - hits
        self.same[hits == hits[first]] = 0.0
        if last_b == b[0]:
            q_now = q0 * np.exp(-beta1 * (t[0] - tau))
            here = first == 0
            base[here] -= last_w * q_now
            self.same[here] += q_now * fade[here]
        self.pre = base * fade
        tail = first[-1]
        gone = np.exp(-beta1 * (t[-1] - t[tail:]))
        q_end = np.bincount(src[tail:], weights=beta1 * gone, minlength=S)
        if last_b == b[-1]:
            q_end = q_end + q0 * np.exp(-beta1 * (t[-1] - tau))
        self.state = (t[-1], int(b[-1]), float(w[-1]), r_end, p_end, q_end)
        self.ev, self.K, self.M, self.carry = ev, K, M, carry

    def mix(self, trace, rho):
        """Per event and source actor: the trace weighed by the route into the event's mark."""
        m = self.ev["mark"]
        return np.einsum("njk,kn->nj", trace.reshape(len(m), self.K, self.M), rho[:, m])


def join_states(x, y, beta0: float, beta1: float):
    """State after ``y`` given the state ``x`` before it."""
    dt = y[0] - x[0]
    d0, d1 = np.exp(-beta0 * dt), np.exp(-beta1 * dt)
    q = y[5] + (x[5] * d1 if x[1] == y[1] else 0.0)
    return (y[0], y[1], y[2], x[3] * d0 + y[3], x[4] * d1 + y[4], q)


def pack_state(s) -> list:
    return [float(s[0]), float(s[1]), float(s[2]), *s[3], *s[4], *s[5]]


def unpack_state(v, S: int):
    v = np.asarray(v, dtype=float)
    return (v[0], int(v[1]), v[2], v[3 : 3 + S], v[3 + S : 3 + 2 * S], v[3 + 2 * S : 3 + 3 * S])


# --- parameters as rows -----------------------------------------------------------------

VECTORS = ("nu", "a0", "a1", "rho0", "rho1")


def params_vector():
    """One flat array column per parameter row, in a fixed order."""
    return F.concat(*[F.col(c) for c in VECTORS], F.array(F.col("beta0"), F.col("beta1")))


def unpack_params(v, K: int, M: int):
    v = np.asarray(v, dtype=float)
    sizes = [K * M, K * K, K * K, M * M, M * M]
    cuts = np.cumsum([0, *sizes])
    nu, a0, a1, r0, r1 = (v[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
    return nu.reshape(K, M), a0.reshape(K, K), a1.reshape(K, K), r0.reshape(M, M), r1.reshape(M, M), float(v[-2]), float(v[-1])


CONTEXT = "chunk long, fit_id long, kind string, cand int, b int, arr array<double>"


def place_weights(lay: Layout, weights: DataFrame) -> DataFrame:
    """Interval weights beside the chunks that use them; worth storing when many passes follow."""
    return lay.cells.join(weights.select("fit_id", "b", "w", "g1"), ["fit_id", "b"])


def context(lay: Layout, params: DataFrame, weights: DataFrame | None, carries: DataFrame | None) -> DataFrame:
    """What each chunk needs beside its events: parameters, interval weights, carried state."""
    p = lay.fits.join(params.select("fit_id", "cand", params_vector().alias("arr")), "fit_id").select(
        "chunk", "fit_id", F.lit("p").alias("kind"), "cand", F.lit(0).alias("b"), "arr"
    )
    out = p
    if weights is not None:
        w = weights if "chunk" in weights.columns else place_weights(lay, weights)
        out = out.unionByName(w.select("chunk", "fit_id", F.lit("g").alias("kind"), F.lit(0).alias("cand"), "b", F.array("w", "g1").alias("arr")))
    if carries is not None:
        out = out.unionByName(carries.select("chunk", "fit_id", F.lit("c").alias("kind"), "cand", F.lit(0).alias("b"), "arr"))
    # fresh column identities, because the events are an ancestor of this table
    return out.select(*[F.col(c).alias(c) for c in out.columns])


def _segments(pdf: pd.DataFrame, ctx: pd.DataFrame, K: int, M: int):
    """Yield every (fit, candidate) of a chunk with its sorted events, weights and parameters."""
    if not len(pdf) or not len(ctx):
        return
    pdf = pdf.sort_values("pos", kind="stable")
    cols = {c: pdf[c].to_numpy() for c in ("t", "b", "actor", "mark", "t_end", "pos", "event_id")}
    ids = pdf["fit_id"].to_numpy()
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
    kinds = {k: g for k, g in ctx.groupby("kind")}
    if "p" not in kinds:  # no fit of the chunk has a candidate
        return
    params: dict = {}
    for f, c, arr in kinds["p"][["fit_id", "cand", "arr"]].itertuples(index=False):
        params.setdefault(f, []).append((c, arr))
    weights: dict = {}
    if "g" in kinds:
        for f, b, arr in kinds["g"][["fit_id", "b", "arr"]].itertuples(index=False):
            weights.setdefault(f, {})[b] = arr
    carries: dict = {}
    if "c" in kinds:
        for f, c, arr in kinds["c"][["fit_id", "cand", "arr"]].itertuples(index=False):
            carries[(f, c)] = unpack_state(arr, K * M)
    for lo, hi in zip(heads[:-1], heads[1:]):
        fit = ids[lo]
        if fit not in params:
            continue
        ev = {c: v[lo:hi] for c, v in cols.items()}
        if fit in weights:
            table = weights[fit]
            wg = np.array([table.get(b, (1.0, 1.0)) for b in ev["b"]])
            w, g1 = wg[:, 0], wg[:, 1]
        else:
            w, g1 = np.ones(hi - lo), np.ones(hi - lo)
        for cand, arr in sorted(params[fit], key=lambda x: x[0]):
            yield fit, cand, ev, w, g1, arr, carries.get((fit, cand)), lo == 0, hi == len(ids)


def carry_states(lay: Layout, params: DataFrame, weights: DataFrame | None) -> DataFrame | None:
    """State carried into each chunk for the fit that continues there, per candidate.

    Each chunk contributes one element (its last fit). Elements combine associatively, so
    chunks are folded in groups of ``FAN``, those groups again, and so on.
    """
    if not lay.spans:
        return None
    K, M = lay.K, lay.M

    def summarise(key, pdf: pd.DataFrame, ctx: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for fit, cand, ev, w, _, arr, _, is_first, is_last in _segments(pdf, ctx, K, M):
            if is_last:
                *_, b0, b1 = unpack_params(arr, K, M)
                seg = Segment(ev, w, b0, b1, K, M)
                rows.append((int(key[0]), fit, cand, bool(is_first), pack_state(seg.state), [b0, b1]))
        return pd.DataFrame(rows, columns=ELEMENT)

    def join(x, y, aux):
        return pack_state(join_states(unpack_state(x, K * M), unpack_state(y, K * M), aux[0], aux[1]))

    ctx = context(lay, params, weights, None)
    elements = lay.events.groupBy("chunk").cogroup(ctx.groupBy("chunk")).applyInPandas(summarise, element_schema(lay))
    out = scan(cut_lineage(elements), lay.n_chunks, join, element_schema(lay))
    return out.select("chunk", "fit_id", "cand", "arr")


ELEMENT = ["chunk", "fit_id", "cand", "whole", "arr", "aux"]


def element_schema(lay: Layout) -> str:
    return f"chunk long, fit_id {dict(lay.events.dtypes)['fit_id']}, cand int, whole boolean, arr array<double>, aux array<double>"


def scan(elements: DataFrame, n: int, join: Callable, schema: str) -> DataFrame:
    """Exclusive segmented scan over ``chunk`` (0..n-1): rows hold the state into ``chunk``.

    ``join(x, y, aux)`` combines states of one fit; an element that is its chunk's only fit
    (``whole``) extends the state before it, any other starts afresh.
    """

    def combine(x, y):
        if x is not None and y[1] and x[0] == y[0]:
            return (y[0], x[1], join(x[2], y[2], y[3]), y[3])
        return y

    def element(r):
        return (r.fit_id, bool(r.whole), list(r.arr), list(r.aux))

    grouped = elements.withColumn("grp", F.floor(F.col("chunk") / FAN).cast("long"))

    def spread(pdf: pd.DataFrame, acc) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("chunk").itertuples():
            acc = combine(acc, element(r))
            rows.append((int(r.chunk) + 1, acc[0], int(r.cand), acc[1], acc[2], acc[3]))
        return pd.DataFrame(rows, columns=ELEMENT)

    if n <= FAN:
        return grouped.groupBy("grp", "cand").applyInPandas(lambda pdf: spread(pdf, None), schema)

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        acc = None
        for r in pdf.itertuples():
            acc = combine(acc, element(r))
        whole = bool(pdf["whole"].all() and pdf["fit_id"].nunique() == 1)
        return pd.DataFrame([(int(key[0]), acc[0], int(key[1]), whole, acc[2], acc[3])], columns=ELEMENT)

    totals = cut_lineage(grouped.groupBy("grp", "cand").applyInPandas(total, schema))
    into = scan(totals, -(-n // FAN), join, schema).select(F.col("chunk").alias("grp"), *[F.col(c) for c in ELEMENT if c != "chunk"])

    def within(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        acc = element(next(start.itertuples())) if len(start) else None
        return spread(pdf, acc) if len(pdf) else pd.DataFrame(columns=ELEMENT)

    return grouped.groupBy("grp", "cand").cogroup(into.groupBy("grp", "cand")).applyInPandas(within, schema)


def chunk_pass(lay: Layout, params: DataFrame, weights: DataFrame | None, fn: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Run ``fn(fit, cand, segment, w, g1, params) -> rows`` on every fit of every chunk.

    ``params`` has one row per fit and candidate; ``weights`` one row per interval. Events
    keep their layout: only the small context is shuffled.
    """
    K, M = lay.K, lay.M
    carries = carry_states(lay, params, weights)
    ctx = context(lay, params, weights, carries)

    def run(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        built = None
        for fit, cand, ev, w, g1, arr, carry, _, _ in _segments(pdf, c, K, M):
            p = unpack_params(arr, K, M)
            # candidates of one fit often share decays and then share their history
            if built is None or built[0] != (fit, p[5], p[6]):
                built = ((fit, p[5], p[6]), Segment(ev, w, p[5], p[6], K, M, carry))
            rows.extend(fn(fit, cand, built[1], w, g1, p))
        return pd.DataFrame(rows, columns=columns)

    return lay.events.groupBy("chunk").cogroup(ctx.groupBy("chunk")).applyInPandas(run, schema)


def sum_vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of ``vec`` per key, added within each task first; what is not a number arrives as null."""
    vec = F.transform("vec", lambda x: F.coalesce(x, F.lit(float("nan"))))
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(vec))).alias("vec"))
