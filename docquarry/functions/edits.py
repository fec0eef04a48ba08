"""Matching blocks and edit scripts of two texts, by anchors that are unique in both and a shortest script between them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Characters of anchors, the longest first.
ANCHORS = (40, 20, 10)
#: Products of the lengths of two stretches up to which the shortest script between them is looked for.
MOST_CELLS = 250_000
Block = tuple[int, int, int]  # start in a, start in b, characters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def once(text: str, size: int) -> dict[str, int]:
    """Where the runs of `size` characters that occur exactly once begin."""
    seen: dict[str, int] = {}
    for k in range(len(text) - size + 1):
        run = text[k : k + size]
        seen[run] = -1 if run in seen else k
    return {run: k for run, k in seen.items() if k >= 0}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of their first numbers, whose second numbers rise."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        if n == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[n], at[n] = j, k
        before[k] = at[n - 1] if n else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters two arrays begin with alike."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """Blocks of a longest common subsequence, from a table of its lengths by rows."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):  # a row at once: the greatest so far from the right
        row = np.maximum(table[i + 1, :-1], (table[i + 1, 1:] + 1) * (b == a[i]))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out: list[Block] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
            else:
                out.append((i, j, 1))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def matching_blocks(a: str, b: str) -> list[Block]:
    """Stretches that both texts have, rising in both: what they begin and end with alike, stretches around anchors, and in short gaps a longest common
    subsequence. Gaps that are too long for it, and hold no anchor, have no block."""
    x, y = code_points(a), code_points(b)
    found: list[Block] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, level = todo.pop()
        head = shared(x[a0:a1], y[b0:b1])
        if head:
            found.append((a0, b0, head))
            a0, b0 = a0 + head, b0 + head
        tail = shared(x[a0:a1][::-1], y[b0:b1][::-1])
        if tail:
            a1, b1 = a1 - tail, b1 - tail
            found.append((a1, b1, tail))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= MOST_CELLS:
            found += [(i + a0, j + b0, n) for i, j, n in common_subsequence(x[a0:a1], y[b0:b1])]
            continue
        if level == len(ANCHORS):
            continue
        size = ANCHORS[level]
        there = once(b[b0:b1], size)
        pairs = rising([(k + a0, there[run] + b0) for run, k in once(a[a0:a1], size).items() if run in there])
        at, bt = a0, b0
        for i, j in pairs:
            if i < at or j < bt:  # within the stretch around the anchor before
                continue
            back = shared(x[at:i][::-1], y[bt:j][::-1])
            ahead = shared(x[i:a1], y[j:b1])
            todo.append((at, i - back, bt, j - back, level))
            found.append((i - back, j - back, back + ahead))
            at, bt = i + ahead, j + ahead
        todo.append((at, a1, bt, b1, level + 1 if not pairs or (at, bt) == (a0, b0) else level))
    found.sort()
    out: list[Block] = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def edit_script(a: str, b: str) -> list[tuple[str, int, int, str]]:
    """What makes b of a: (delete, insert or replace; from, to in a; new text), in order."""
    out = []
    at = bt = 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i > at or j > bt:
            out.append(("replace" if i > at and j > bt else "delete" if i > at else "insert", at, i, b[bt:j]))
        at, bt = i + n, j + n
    return out


def applied(a: str, script: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, start, end, new in script:
        out += (a[at:start], new)
        at = end
    return "".join([*out, a[at:]])


def undone(b: str, a_parts: list[tuple[int, int, str]]) -> str:
    """a again from b and, for each edit, (from, to in b; what a has there)."""
    out, at = [], 0
    for start, end, old in a_parts:
        out += (b[at:start], old)
        at = end
    return "".join([*out, b[at:]])
