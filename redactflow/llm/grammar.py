"""Sequences of role and fault symbols, compressed by Re-Pair, and the cheapest edits of whole grammars.

Symbols are one character for each turn: ``s u a o`` by the initial of its role (system, user, assistant, any other),
upper case if the turn is truncated, ``x`` if it must go. Edits: keep (K, 0), rerole to user or assistant (R, 1), delete
(D, 2), insert an empty turn (I, 5); a truncated turn that stays costs 5 more. What stays must read ``(s?(ua)+)?``.

A symbol's transfer matrix tells for each pair of states of that pattern the least cost of getting from one to the other
over this symbol, insertions in front of it included, and the audit of doing so. Matrices multiply in the (min, +)
semiring whose elements are (cost, audit), ordered by cost and then by audit in ASCII order. Every audit of a symbol ends
with the letter of its turn and has no other such letter, so no audit of a sequence is a proper beginning of another:
the order survives putting audits together, and a least product of least parts is least. Insertions after the last turn
are added once, at the end.

Audits are ropes, pairs of ropes with a length and a polynomial hash, so that a rule of the grammar adds one node for
each entry; two ropes are compared by walking down to where their hashes first differ.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

STATES = ("start", "system", "user", "assistant")
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
ROLE_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
#: Where a turn of a role leads.
MOVES = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: How many inserted turns lead from one state to another.
INSERTS = {0: {0: 0, 2: 1, 3: 2}, 1: {1: 0, 2: 1, 3: 2}, 2: {2: 0, 3: 1}, 3: {3: 0, 2: 1}}
#: Inserted turns that end a conversation properly.
CLOSING = (0, 2, 1, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SYMBOLS = "suaoSUAOx"

_PRIME = (1 << 61) - 1
_FACTOR = 0x1D4E5F2A7B3C9


class Rope:
    __slots__ = ("left", "right", "size", "hash", "_text")

    def __init__(self, left: Rope | None, right: Rope | None, text: str | None = None) -> None:
        self.left, self.right, self._text = left, right, text
        if text is not None:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * _FACTOR + ord(c)) % _PRIME
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_FACTOR, right.size, _PRIME) + right.hash) % _PRIME

    def __str__(self) -> str:
        if self._text is None:
            out, todo = [], [self]
            while todo:
                node = todo.pop()
                if node._text is None:
                    todo += (node.right, node.left)
                else:
                    out.append(node._text)
            self._text_of(out)
        return self._text

    def _text_of(self, parts: list[str]) -> None:
        # the children stay: they are shared, and comparing needs them
        self._text = "".join(parts)


def less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes before ``b``; neither is a proper beginning of the other."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y or (x.size == y.size and x.hash == y.hash):
            continue
        if x.left is None and y.left is None:
            if x._text != y._text:
                return x._text < y._text
        elif y.left is None or (x.left is not None and x.size >= y.size):
            left += (x.right, x.left)
            right.append(y)
        else:
            right += (y.right, y.left)
            left.append(x)
    return False


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]
NOTHING = Rope(None, None, "")


def terminal(symbol: str) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]

    def offer(a: int, b: int, cost: int, audit: str) -> None:
        if out[a][b] is None or (cost, audit) < (out[a][b][0], str(out[a][b][1])):
            out[a][b] = (cost, Rope(None, None, audit))

    extra = TRUNCATED if symbol.isupper() else 0
    for a, ways in INSERTS.items():
        for here, n in ways.items():
            before, cost = "I" * n, INSERT * n
            offer(a, here, cost + DELETE, before + "D")
            if symbol == "x":
                continue
            if (here, symbol.lower()) in MOVES:
                offer(a, MOVES[here, symbol.lower()], cost + KEEP + extra, before + "K")
            for role in "ua":
                if (here, role) in MOVES:
                    offer(a, MOVES[here, role], cost + REROLE + extra, before + "R")
    return out


def _sum(a: Entry, b: Entry) -> Entry:
    return (a[0] + b[0], Rope(a[1], b[1]) if a[1].size and b[1].size else (a[1] if a[1].size else b[1]))


def row_times(row: list[Entry | None], m: Matrix) -> list[Entry | None]:
    out: list[Entry | None] = [None] * 4
    for k, first in enumerate(row):
        if first is None:
            continue
        for j, second in enumerate(m[k]):
            if second is None:
                continue
            best = out[j]
            if best is None or first[0] + second[0] <= best[0]:
                made = _sum(first, second)
                if best is None or made[0] < best[0] or less(made[1], best[1]):
                    out[j] = made
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [row_times(row, b) for row in a]


def identity() -> Matrix:
    return [[(0, NOTHING) if i == j else None for j in range(4)] for i in range(4)]


def closed(row: list[Entry | None]) -> tuple[int, str]:
    """The cheapest way from the start to a proper end, given the ways to every state: cost and audit."""
    return min((e[0] + INSERT * n, str(e[1]) + "I" * n) for e, n in zip(row, CLOSING, strict=True) if e is not None)


def re_pair(sequences: Iterable[list[int]], first_new: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Replace the most frequent pair of neighbours by a new symbol until none occurs twice (Larsson and Moffat, 1999):
    the sequences left, and the rules; rule ``i`` defines symbol ``first_new + i``."""
    sym: list[int] = []
    heads = []
    for s in sequences:
        heads.append((len(sym), len(s)))
        sym += s
        sym.append(-1)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            where.setdefault((sym[i], sym[i + 1]), set()).add(i)
    heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        now = len(where.get(pair, ()))
        if now < 2:
            continue
        if now != -count:
            heapq.heappush(heap, (-now, pair))
            continue
        a, b = pair
        new = first_new + len(rules)
        rules.append(pair)
        touched = set()
        for i in sorted(where.pop(pair)):
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # overlapped by the occurrence before
            p, q = before[i], after[j]
            if p >= 0 and sym[p] >= 0:
                where.get((sym[p], a), set()).discard(p)
                where.setdefault((sym[p], new), set()).add(p)
                touched.add((sym[p], new))
            if sym[q] >= 0:
                where.get((b, sym[q]), set()).discard(j)
                where.setdefault((new, sym[q]), set()).add(i)
                touched.add((new, sym[q]))
            sym[i], sym[j] = new, -2
            after[i], before[q] = q, i
        for t in touched:
            if len(where.get(t, ())) > 1:
                heapq.heappush(heap, (-len(where[t]), t))
    out = []
    for head, size in heads:
        left, i = [], head
        while size and sym[i] != -1:
            left.append(sym[i])
            i = after[i]
        out.append(left)
    return out, rules


_TERMINALS = [terminal(s) for s in SYMBOLS]
_NUMBER = {s: i for i, s in enumerate(SYMBOLS)}


def transfer(texts: list[str], whole: bool) -> list[Matrix] | list[list[Entry | None]]:
    """For each sequence its matrix (``whole``) or only the row of the start, over one grammar of all sequences."""
    left, rules = re_pair([[_NUMBER[c] for c in t] for t in texts], len(SYMBOLS))
    matrices = list(_TERMINALS)
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    out = []
    for s in left:
        if whole:
            m = identity()
            for i in s:
                m = times(m, matrices[i])
            out.append(m)
        else:
            row = identity()[_START]
            for i in s:
                row = row_times(row, matrices[i])
            out.append(row)
    return out
