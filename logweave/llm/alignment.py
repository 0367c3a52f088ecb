"""Cheapest edits that turn a run of turns into ``(s?(ua)+)?``: Wagner-Fischer tables in Ukkonen bands.

A turn is a symbol: its role's class (s, u, a or another) and its fault (none, blank, duplicate, truncated).  Edits
and costs: Keep 0, Rerole to u or a 1, Delete 2, Insert u or a 5; a truncated turn that stays costs 5 more, blank and duplicate turns must go.

Turns are aligned with the string u a u a ... of every length that the band admits.  The tables are filled from the
end: cell (i, k) is the least cost of aligning turns i, i+1, ... with the last k symbols, so one table serves all lengths that
end alike, and a walk from (0, length) that takes the first possible of D, I, K, R gives the ASCII-least audit of that length.
A cell whose missing or surplus turns alone cost more than an incumbent (a simple repair that always works) is left out.

Long conversations come in pieces.  A piece is aligned for every state of the grammar that it can be entered in
and left in (``piece_table``), and ``chain`` joins the pieces.  Inserts between two pieces belong to
the later one, so two audits of one piece differ before either ends, and choosing piece by piece gives the least audit of all.
"""

from __future__ import annotations

import numpy as np

S, U, A, OTHER = range(4)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a.
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (NONE, AFTER_A)
_FAR = 1 << 40


def symbol(role_class: int, fault: int) -> str:
    return chr(65 + 4 * role_class + fault)


def _read(symbols: str) -> tuple[list[int], list[int]]:
    codes = [ord(c) - 65 for c in symbols]
    return [c // 4 for c in codes], [c % 4 for c in codes]


def _incumbent(classes, faults, last: bool) -> int:
    """The cost of a plain repair: faulty turns go, others take the role that is due."""
    cost, due = 0, U
    for c, f in zip(classes, faults):
        if f:
            cost += DELETE
        else:
            cost += REROLE * (c != due)
            due = U + A - due
    return cost + INSERT * (last and due == A)


class _Table:
    """Costs of aligning each suffix of the turns with the last k symbols of ...uaua or ...auau."""

    def __init__(self, classes, faults, end: int, budget: int, last: bool):
        self.classes, self.faults, self.end = classes, faults, end
        n = len(classes)
        width = n + budget // INSERT + 2
        self.cost = np.full((n + 1, width), _FAR, np.int64)
        k = np.arange(width)
        inserts = INSERT * k
        other = U + A - end
        wrong = {c: REROLE * (np.where(k % 2 == 1, end, other) != c) for c in (S, U, A, OTHER)}
        self.cost[n, 0] = 0
        if last:
            top = min(width, budget // INSERT + 1)
            self.cost[n, :top] = inserts[:top]
        for i in range(n - 1, -1, -1):
            left = n - i
            lo, hi = max(0, left - budget // DELETE), min(width, left + budget // INSERT + 1)
            below = self.cost[i + 1]
            row = below[lo:hi] + DELETE
            if faults[i] not in (BLANK, DUPLICATE):
                stay = wrong[classes[i]] + (CUT_SHORT if faults[i] == TRUNCATED else 0)
                a = max(lo, 1)
                np.minimum(row[a - lo:], below[a - 1:hi - 1] + stay[a:hi], out=row[a - lo:])
            row = np.minimum.accumulate(row - inserts[lo:hi]) + inserts[lo:hi]
            self.cost[i, lo:hi] = np.minimum(row, _FAR)
        self.cost[:, 0] = DELETE * np.arange(n, -1, -1)

    def with_s(self) -> np.ndarray:
        """Costs with an s in front of the last k symbols: only a kept turn of that class gives one."""
        out = np.full_like(self.cost, _FAR)
        for i in range(len(self.classes) - 1, -1, -1):
            out[i] = np.minimum(out[i + 1] + DELETE, _FAR)
            if self.classes[i] == S and self.faults[i] in (0, TRUNCATED):
                np.minimum(out[i], self.cost[i + 1] + (CUT_SHORT if self.faults[i] else 0), out=out[i])
        return out

    def audit(self, k: int, front: np.ndarray | None = None) -> str:
        """The ASCII-least cheapest edits for the last k symbols, behind an s if ``front`` (of ``with_s``) is given."""
        out, i, n, cost = [], 0, len(self.classes), self.cost
        if front is not None:
            while front[i + 1, k] + DELETE == front[i, k]:
                out.append("D")
                i += 1
            out.append("K")
            i += 1
        while i < n or k:
            here = cost[i, k]
            if i < n and cost[i + 1, k] + DELETE == here:
                out.append("D")
                i += 1
            elif k and cost[i, k - 1] + INSERT == here:
                out.append("I")
                k -= 1
            else:
                due = self.end if k % 2 else U + A - self.end
                out.append("K" if self.classes[i] == due else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def _least(options) -> tuple[int, str] | None:
    """Least cost, then ASCII-least audit, of (table, front, lengths)."""
    found = []
    for table, front, first, step in options:
        costs = (table.cost if front is None else front)[0, first::step]
        if len(costs) and costs.min() < _FAR:
            found += [(int(c), table, front, first + step * int(j)) for c in [costs.min()] for j in np.flatnonzero(costs == c)]
    if not found:
        return None
    best = min(f[0] for f in found)
    return best, min(t.audit(k, front) for c, t, front, k in found if c == best)


def piece_table(symbols: str, first: bool = True, last: bool = True) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) -> (cost, audit) of one piece of a conversation."""
    classes, faults = _read(symbols)
    # An entry or exit in the other phase costs one insert more at most.
    budget = _incumbent(classes, faults, last) + 2 * INSERT
    to_a = _Table(classes, faults, A, budget, last)
    to_u = None if last else _Table(classes, faults, U, budget, last)
    out = {}
    for entry in (NONE,) if first else (NONE, AFTER_S, AFTER_U, AFTER_A):
        for leave in ENDS if last else (NONE, AFTER_S, AFTER_U, AFTER_A):
            table = to_u if leave == AFTER_U else to_a
            options = []
            if leave == entry:
                options.append((table, None, 0, 1 << 60))  # every turn goes
            if leave in (AFTER_U, AFTER_A):
                # From "u is due" an end in a takes an even number of symbols, an end in u an odd one; after u the other way round.
                odd = (leave == AFTER_U) != (entry == AFTER_U)
                options.append((table, None, 1 if odd else 2, 2))
                if entry == NONE:
                    options.append((table, table.with_s(), 1 if odd else 2, 2))
            if entry == NONE and leave == AFTER_S:
                options.append((to_a, to_a.with_s(), 0, 1 << 60))
            best = _least(options)
            if best is not None:
                out[entry, leave] = best
    return out


def chain(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, [(entry, audit) of each piece]) of the cheapest repair of a conversation, ties to the ASCII-least audit."""
    after = {state: 0 for state in ENDS}
    rests = [after]
    for table in reversed(tables):
        now: dict[int, int] = {}
        for (entry, leave), (cost, _) in table.items():
            if leave in after:
                now[entry] = min(now.get(entry, _FAR), cost + after[leave])
        rests.append(after := now)
    rests.reverse()
    state, path = NONE, []
    for table, here, then in zip(tables, rests, rests[1:]):
        audit, leave = min((a, x) for (e, x), (c, a) in table.items() if e == state and x in then and c + then[x] == here[state])
        path.append((state, audit))
        state = leave
    return rests[0][NONE], path


def counts(symbols: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose initials are not su, ua or au."""
    classes, faults = _read(symbols)
    illegal = sum(pair not in ((S, U), (U, A), (A, U)) for pair in zip(classes, classes[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def repaired(entry: int, audit: str, turns):
    """The (role, text) that the edits leave of the ``turns`` (role, text) of one piece."""
    state = entry
    turns = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == AFTER_U else "user"
        state = AFTER_S if role[:1] == "s" else AFTER_U if role[:1] == "u" else AFTER_A
        yield role, text
