"""The M-step's sums for all fits and candidates of a chunk at once.

Short fits advance side by side, one event of each per step, and candidates that share decays
share their history. Fits that are long within a chunk are laid out along time instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from flockwise.operators.history import EPS, Segment, unpack_state

#: Longer stretches of one fit are summed along time; shorter ones step side by side.
LONG = 512
#: Event-candidate rows that are expanded together.
EXPAND = 8_000


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts`` with ``sizes`` places, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def decayed_scan(step: np.ndarray, x: np.ndarray) -> None:
    """Turn rows ``x`` into ``x[n] + step[n] * (row before)`` in place, by doubling; a step of 0 begins a series."""
    step, d = step.copy(), 1
    while d < len(x) and step.any():
        x[d:] += step[d:, None] * x[:-d]
        step[d:] *= step[:-d]
        step[:d] = 0.0
        d *= 2


def _before(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What each row finds of the row before it."""
    out = np.zeros_like(x)
    out[1:] = step[1:, None] * x[:-1]
    return out


class Events:
    """Events of a chunk in order, and where each of its fits begins."""

    def __init__(self, pdf: pd.DataFrame, K: int, M: int):
        pdf = pdf.sort_values("pos", kind="stable")
        self._hold(K, M, pdf["fit_id"].to_numpy(), *(pdf[c].to_numpy() for c in ("t", "b", "actor", "mark", "t_end")))

    def _hold(self, K, M, fit_id, t, b, i, m, t_end) -> None:
        self.K, self.M, self.S = K, M, K * M
        self.t, self.b, self.i, self.m, self.t_end = t, b, i, m, t_end
        self.src = i * M + m
        self.heads = np.flatnonzero(np.r_[True, fit_id[1:] != fit_id[:-1]]) if len(fit_id) else np.zeros(0, int)
        self.sizes = np.diff(np.r_[self.heads, len(fit_id)])
        self.ids = fit_id[self.heads]
        self.w = np.ones(len(fit_id))

    def taken(self, keep: np.ndarray) -> Events:
        """The events of some of the fits."""
        out, at = Events.__new__(Events), np.repeat(keep, self.sizes)
        out._hold(self.K, self.M, np.repeat(self.ids, self.sizes)[at], *(x[at] for x in (self.t, self.b, self.i, self.m, self.t_end)))
        return out

    def traces(self, fit: np.ndarray, b0: np.ndarray, b1: np.ndarray, carry: list):
        """Traces before each event for histories (fit, decays, carried state): rows of R, pre and same, and each history's start."""
        sizes, heads = self.sizes[fit], self.heads[fit]
        starts = np.cumsum(sizes) - sizes
        R, pre, same = (np.empty((int(sizes.sum()), self.S)) for _ in range(3))
        for h in np.flatnonzero(sizes > LONG):
            here, out = slice(heads[h], heads[h] + sizes[h]), slice(starts[h], starts[h] + sizes[h])
            ev = {"t": self.t[here], "b": self.b[here], "actor": self.i[here], "mark": self.m[here]}
            seg = Segment(ev, self.w[here], b0[h], b1[h], self.K, self.M, carry[h])
            R[out], pre[out], same[out] = seg.R, seg.pre, seg.same
        short = np.flatnonzero(sizes <= LONG)
        self._step(short[np.argsort(-sizes[short], kind="stable")], sizes, heads, starts, b0, b1, carry, R, pre, same)
        return R, pre, same, starts

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the events of an interval begin, and each event's place among these stretches."""
        head = np.zeros(len(self.t), bool)
        head[self.heads] = True
        head[1:] |= self.b[1:] != self.b[:-1]
        return np.flatnonzero(head), np.cumsum(head) - 1

    def scanned(self, firsts: np.ndarray, of: np.ndarray, beta: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mass of earlier intervals and of the same interval before each event and per source, for decays per event.

        Intervals are scanned first, their totals along their fits next; all terms are positive, and every fit and interval goes side by side.
        ``w`` weighs whole intervals, so it is the same for all events of one. A fit whose decay or weights are not finite gets
        rows that are not finite, and the others do not meet them.
        """
        lost = ~np.isfinite(beta) if w is None else ~(np.isfinite(beta) & np.isfinite(w))
        if lost.any():
            lost = np.repeat(np.logical_or.reduceat(lost, self.heads), self.sizes)
            beta, w = np.where(lost, 1.0, beta), None if w is None else np.where(lost, 1.0, w)
        n, lasts = len(self.t), np.r_[firsts, len(self.t)][1:] - 1
        step = np.exp(-beta * np.diff(self.t, prepend=0.0), where=np.diff(of, prepend=-1) == 0, out=np.zeros(n))
        mass = np.zeros((n, self.S))
        mass[np.arange(n), self.src] = beta
        decayed_scan(step, mass)
        same = _before(step, mass)
        total = mass[lasts] if w is None else mass[lasts] * w[lasts][:, None]
        fit = np.repeat(np.arange(len(self.sizes)), self.sizes)[firsts]
        inner, rate = np.diff(fit, prepend=-1) == 0, beta[firsts]
        hop = np.exp(-rate * np.diff(self.t[lasts], prepend=0.0), where=inner, out=np.zeros(len(firsts)))
        decayed_scan(hop, total)
        gap = np.exp(-rate * (self.t[firsts] - np.r_[0.0, self.t[lasts[:-1]]]), where=inner, out=np.zeros(len(firsts)))
        earlier = _before(gap, total)[of] * np.exp(-beta * (self.t - self.t[firsts][of]))[:, None]
        if lost.any():
            earlier[lost] = same[lost] = np.nan
        return earlier, same

    def _step(self, hs, sizes, heads, starts, b0, b1, carry, R, pre, same):
        if not len(hs):
            return
        b0, b1, length, head, start = b0[hs], b1[hs], sizes[hs], heads[hs], starts[hs]
        r, p, before, now = (np.zeros((len(hs), self.S)) for _ in range(4))
        last_t, last_b = self.t[head].copy(), np.full(len(hs), -1)
        for k, h in enumerate(hs):
            if carry[h] is not None:
                last_t[k], last_b[k], last_w, r[k], p[k], now[k] = carry[h]
                before[k] = p[k] - last_w * now[k]
        for j in range(int(length[0])):
            n = int(np.searchsorted(-length, -j, "left"))  # histories with more than j events
            row, out, each = head[:n] + j, start[:n] + j, np.arange(n)
            dt = self.t[row] - last_t[:n]
            r[:n] *= np.exp(-b0[:n] * dt)[:, None]
            fade = np.exp(-b1[:n] * dt)[:, None]
            for x in (p, before, now):
                x[:n] *= fade
            fresh = np.flatnonzero(self.b[row] != last_b[:n])
            before[fresh], now[fresh] = p[fresh], 0.0
            R[out], pre[out], same[out] = r[:n], before[:n], now[:n]
            src = self.src[row]
            r[each, src] += b0[:n]
            p[each, src] += b1[:n] * self.w[row]
            now[each, src] += b1[:n]
            last_t[:n], last_b[:n] = self.t[row], self.b[row]


class Chunk(Events):
    """Events of a chunk, their interval weights, and the parameter rows of its fits."""

    def __init__(self, pdf: pd.DataFrame, ctx: pd.DataFrame, K: int, M: int):
        super().__init__(pdf, K, M)
        index = pd.Index(self.ids)
        place = np.repeat(np.arange(len(index)), self.sizes)
        kinds = dict(iter(ctx.groupby("kind")))
        rows = kinds.get("p", ctx.iloc[:0]).sort_values(["fit_id", "cand"])
        rows = rows.assign(at=index.get_indexer(rows["fit_id"])).query("at >= 0")
        self.fit_ids, self.cands, self.fit_of = rows["fit_id"].to_numpy(), rows["cand"].to_numpy(), rows["at"].to_numpy()
        flat = np.stack(rows["arr"].to_list()) if len(rows) else np.empty((0, 0))
        cut = np.cumsum([K * M, K * K, K * K, M * M, M * M]) if len(rows) else None
        if cut is not None:
            nu, a0, a1, r0, r1, decays = np.split(flat, cut, axis=1)
            self.nu, self.a0, self.a1 = nu.reshape(-1, K, M), a0.reshape(-1, K, K), a1.reshape(-1, K, K)
            self.rho0, self.rho1, self.decays = r0.reshape(-1, M, M), r1.reshape(-1, M, M), decays
        self.g1 = np.ones(len(self.t))
        if "g" in kinds:
            g = kinds["g"]
            at, width = index.get_indexer(g["fit_id"]), int(max(g["b"].max(), self.b.max())) + 1
            table = np.ones((len(index) * width, 2))
            table[(at * width + g["b"].to_numpy())[at >= 0]] = np.stack(g["arr"].to_list())[at >= 0]
            self.w, self.g1 = table[place * width + self.b].T
        self.carried = {}
        if "c" in kinds:
            self.carried = {(f, c): unpack_state(a, self.S) for f, c, a in kinds["c"][["fit_id", "cand", "arr"]].itertuples(index=False)}

    def histories(self):
        """Traces per distinct (fit, decays), and each row's history."""
        keys, first, of = np.unique(np.column_stack([self.fit_of, self.decays]), axis=0, return_index=True, return_inverse=True)
        carry = [self.carried.get((self.fit_ids[p], self.cands[p])) for p in first]
        return *self.traces(keys[:, 0].astype(int), keys[:, 1], keys[:, 2], carry), of.ravel()

    def score_and_gradient(self, horizon: float, gradient: bool) -> list[tuple]:
        """Rows (fit, candidate, [Q, gradients in A1, A0, rho0, rho1]) of this chunk's events."""
        if not len(self.fit_of):
            return []
        R, pre, same, starts, of = self.histories()
        sizes = self.sizes[self.fit_of]
        block = np.floor((np.cumsum(sizes) - sizes) / EXPAND)
        out = []
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])), strict=True):
            sets = slice(lo, hi)
            vec = self._sums(sets, R, pre, same, starts[of[sets]], horizon, gradient)
            out += list(zip(self.fit_ids[sets].tolist(), self.cands[sets].tolist(), vec.tolist(), strict=True))
        return out

    def _sums(self, sets, R, pre, same, starts, horizon, gradient):
        K, M, sizes = self.K, self.M, self.sizes[self.fit_of[sets]]
        P = len(sizes)
        ev, hist, q = runs(self.heads[self.fit_of[sets]], sizes), runs(starts, sizes), np.repeat(np.arange(P), sizes)
        a0, a1, rho0, rho1, nu, decays = (x[sets] for x in (self.a0, self.a1, self.rho0, self.rho1, self.nu, self.decays))
        i, m, w, g1, n = self.i[ev], self.m[ev], self.w[ev], self.g1[ev], len(ev)
        into = lambda a, x: a.transpose(0, 2, 1)[q, x]  # noqa: E731  column x of each row's matrix
        a0i, a1i, r0m, r1m = into(a0, i), into(a1, i), into(rho0, m), into(rho1, m)
        shaped = [x[hist].reshape(n, K, M) for x in (R, pre, same)]
        fr, f0, fs = (np.einsum("njk,nk->nj", x, r) for x, r in zip(shaped, (r0m, r1m, r1m), strict=True))
        f1 = f0 + fs
        base = nu[q, i, m] + (fr * a0i).sum(1)
        lam0, lam1 = np.maximum(base + (f0 * a1i).sum(1), EPS), np.maximum(base + (f1 * a1i).sum(1), EPS)
        b0, b1 = decays[q].T
        left, rest = horizon - self.t[ev], np.maximum(self.t_end[ev] - self.t[ev], 0.0)
        c0, e1 = -np.expm1(-b0 * left), np.exp(-b1 * rest)
        c1 = w * (e1 - np.exp(-b1 * left)) + g1 * (1.0 - e1)
        s0, s1, out0, out1 = rho0.sum(2)[q, m], rho1.sum(2)[q, m], a0.sum(2)[q, i], a1.sum(2)[q, i]
        g0 = 1.0 - g1
        add = lambda key, x, size: np.bincount(key, weights=x, minlength=P * size).reshape(P, size)
        score = add(q, g0 * np.log(lam0) + g1 * np.log(lam1) - out0 * s0 * c0 - out1 * s1 * c1, 1)
        if not gradient:
            return score
        x0, x1 = g0 / lam0, g1 / lam1
        both = x0 + x1
        actor, mark = q * K + i, q * M + m

        def gathered(key, columns, minus, size):
            g = np.stack([add(key, c, size) for c in columns.T], axis=1) - add(key, minus, size)[:, :, None]
            return g.reshape(P, size * size)

        by_route = lambda x, a: np.einsum("njk,nj->nk", x, a)
        route0, before, now = by_route(shaped[0], a0i), by_route(shaped[1], a1i), by_route(shaped[2], a1i)
        return np.hstack([
            score,
            gathered(actor, x0[:, None] * f0 + x1[:, None] * f1, s1 * c1, K), gathered(actor, both[:, None] * fr, s0 * c0, K),
            gathered(mark, both[:, None] * route0, out0 * c0, M), gathered(mark, both[:, None] * before + x1[:, None] * now, out1 * c1, M),
        ])
