"""The whole Lasso path in one sweep (survey 2.H, H5): homotopy on the Gram matrix.

For (1/2n)||y - Zw||^2 + alpha ||w||_1 the solution is piecewise linear in lam = n alpha.  From the lam at which the
first feature enters, the sweep goes from event to event: a feature joins the active set when its
correlation with the residual reaches lam, and drops out when its coefficient reaches zero.  Between two events

    w_A(lam) = G_AA^-1 (c_A - lam s_A)

for the signs s_A of the active correlations, so every alpha of a grid is read off by one formula and no coordinate
is visited in a loop.  Cost: one factorisation of the active Gram per event, whatever the number of rows.

Collinear features: what each inactive feature keeps beside the active ones (the diagonal of the Schur
complement, from the same factorisation) reveals the rank.  A feature the active ones span has a correlation that stays in a
fixed ratio to lam, so it cannot join before one of them drops out; it is passed over until then.  Of features that
join at the same lam the first in order joins first.
"""

from __future__ import annotations

import numpy as np

SPANNED = 1e-10     # share of a feature's length left beside the active ones below which it is spanned
MAX_EVENTS = 50     # events per feature before the sweep gives up; coordinate descent then takes over
SLOPE = 1e-9


def kkt_violation(ZZ: np.ndarray, Zy: np.ndarray, w: np.ndarray, lam: float) -> float:
    """How far w is from the optimum at lam, as a share of the largest correlation: an active correlation off
    lam, or an inactive one beyond it."""
    c = Zy - ZZ @ w
    on = w != 0
    off = np.concatenate([np.abs(c[on] - lam * np.sign(w[on])), np.maximum(0.0, np.abs(c[~on]) - lam)])
    return float(off.max(initial=0.0) / max(float(np.abs(Zy).max(initial=0.0)), 1e-300))


def lasso_path(ZZ: np.ndarray, Zy: np.ndarray, lams: np.ndarray) -> np.ndarray | None:
    """Coefficients (a row per lam; lams fall) on the centred Gram; None where the events don't end."""
    d, out, todo = len(Zy), np.zeros((len(lams), len(Zy))), 0
    usable = np.diag(ZZ) > 0
    at = float(np.abs(Zy[usable]).max(initial=0.0))
    active: list[int] = []
    signs = np.zeros(d)
    left = None                     # the feature that dropped out in the event before
    for event in range(MAX_EVENTS * (d + 1)):
        while todo < len(lams) and (lams[todo] >= at and not active):
            todo += 1               # nothing is active above the first event
        if todo == len(lams):
            return out
        rest = np.flatnonzero(usable & ~np.isin(np.arange(d), active))
        c, slope, move, free = _directions(ZZ, Zy, active, signs, at, rest)
        best, who, joins = at, None, False
        if active:
            w = _solve(ZZ, Zy, active, signs, at)
            s = signs[active]
            for k in np.flatnonzero(s * move < 0):      # those that move towards zero
                step = max(0.0, s[k] * w[k]) / abs(move[k])
                if step < best:
                    best, who, joins = step, active[k], False
        for k in np.flatnonzero(free):
            for sign in (1.0, -1.0):
                fall = 1.0 - sign * slope[k]            # how fast lam closes in on this correlation
                if fall > SLOPE and not (rest[k] == left and sign == signs[left]):
                    step = max(0.0, at - sign * c[k]) / fall
                    if step < best:
                        best, who, joins, entering = step, rest[k], True, sign
        after = at - best
        while todo < len(lams) and lams[todo] >= after:
            if active:
                out[todo, active] = _solve(ZZ, Zy, active, signs, min(at, lams[todo]))
            todo += 1
        if who is None:
            return out if todo == len(lams) else None
        at, left = after, None
        if joins:
            active.append(int(who))
            signs[who] = entering
        else:
            active.remove(int(who))
            left = int(who)
    return None


def _solve(ZZ, Zy, active, signs, lam) -> np.ndarray:
    g = ZZ[np.ix_(active, active)]
    return np.linalg.solve(g, Zy[active] - lam * signs[active])


def _directions(ZZ, Zy, active, signs, at, rest):
    """Correlations of the inactive features, their slopes and the active coefficients' as lam falls by one,
    and which inactive features the active ones don't span."""
    diag = np.diag(ZZ)[rest]
    if not active:
        return Zy[rest], np.zeros(len(rest)), np.zeros(0), np.ones(len(rest), bool)
    cross = ZZ[np.ix_(active, rest)]
    x = np.linalg.solve(ZZ[np.ix_(active, active)], np.column_stack([signs[active], Zy[active] - at * signs[active], cross]))
    move, w, beside = x[:, 0], x[:, 1], x[:, 2:]
    kept = diag - np.einsum("ij,ij->j", cross, beside)
    return Zy[rest] - cross.T @ w, cross.T @ move, move, kept > SPANNED * diag
