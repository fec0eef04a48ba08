"""Metric trees by the anchors hierarchy, and nearest entries of all their points.

A tree is built from the middle out: about as many anchors as the root of the number of points are chosen, each the point furthest from
its anchor so far, and takes the points that are nearer to it than to their own anchor (those nearer to that anchor than half the distance of
the two anchors need no look). Anchors are merged upwards, the two with the smallest common ball first, and each is divided
downwards the same way. A ball caches the sum and the count of its points.

Points are distinct integer vectors with weights. Bounds are in floating point with a margin; distances that decide are whole numbers.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, fields

import numpy as np

LEAF = 32


@dataclass(frozen=True)
class Tree:
    points: np.ndarray  # distinct, in tree order
    weights: np.ndarray
    place: np.ndarray  # of each given row, among points
    start: np.ndarray  # a ball holds points[start : end]; ball 0 holds all
    end: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    radius: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as found:
            return cls(**{f.name: found[f.name] for f in fields(cls)})


def anchored(points: np.ndarray, want: int) -> np.ndarray:
    """The anchor (0 to want - 1) that owns each of the distinct points."""
    owner = np.zeros(len(points), np.int64)
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    at = [0]
    for k in range(1, want):
        new = int(gap.argmax())
        half = np.sqrt(((points[at] - points[new]) ** 2).sum(axis=1)) / 2
        look = np.flatnonzero(gap >= half[owner])
        found = np.sqrt(((points[look] - points[new]) ** 2).sum(axis=1))
        nearer = found < gap[look]
        owner[look[nearer]], gap[look[nearer]] = k, found[nearer]
        at.append(new)
    return owner


def grown(rows: np.ndarray) -> Tree:
    """The tree of the rows (n, d) of whole numbers, n at least 1."""
    points, place, weights = np.unique(rows.astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    exact = points.astype(np.float64)
    balls: list[tuple[np.ndarray, int, int, np.ndarray, int, float]] = []  # own points, children, sum, count, radius

    def ball(own: np.ndarray, left: int = -1, right: int = -1) -> int:
        total, count = weights[own] @ points[own], int(weights[own].sum())
        radius = float(np.sqrt(((exact[own] - total / count) ** 2).sum(axis=1)).max())
        balls.append((own, left, right, total, count, radius))
        return len(balls) - 1

    def divided(own: np.ndarray) -> int:
        if len(own) <= LEAF:
            return ball(own)
        owner = anchored(exact[own], max(2, round(len(own) ** 0.5)))
        return merged([divided(own[owner == k]) for k in range(owner.max() + 1)])

    def merged(live: list[int]) -> int:
        centre = np.array([balls[k][3] / balls[k][4] for k in live])
        radius = np.array([balls[k][5] for k in live])
        common = np.maximum((radius[:, None] + radius + np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2))) / 2, np.maximum(radius[:, None], radius))
        np.fill_diagonal(common, np.inf)
        for _ in range(len(live) - 1):
            a, b = divmod(int(common.argmin()), len(live))
            live[a] = ball(np.concatenate([balls[live[a]][0], balls[live[b]][0]]), live[a], live[b])
            centre[a], radius[a] = balls[live[a]][3] / balls[live[a]][4], balls[live[a]][5]
            gone = np.isinf(common[a])
            common[a] = np.maximum((radius[a] + radius + np.sqrt(((centre - centre[a]) ** 2).sum(axis=1))) / 2, np.maximum(radius[a], radius))
            common[a, gone] = np.inf
            common[:, a] = common[a]
            common[b], common[:, b] = np.inf, np.inf
            last = a
        return live[last]

    root = divided(np.arange(len(points)))
    down, order, laid, todo = [], [], 0, [root]  # balls from the root down, leaves from left to right
    span: dict[int, tuple[int, int]] = {}
    while todo:
        k = todo.pop()
        down.append(k)
        own, left, right, *_ = balls[k]
        span[k] = (laid, laid + len(own))
        if left < 0:
            order.append(own)
            laid += len(own)
        else:
            todo += [right, left]
    number = {k: i for i, k in enumerate(down)} | {-1: -1}
    tree_order = np.concatenate(order)
    back = np.empty(len(points), np.int64)
    back[tree_order] = np.arange(len(points))
    column = lambda f, kind: np.array([f(k) for k in down], kind)
    return Tree(
        points[tree_order].astype(np.int32), weights[tree_order], back[place.reshape(-1)].astype(np.int32),
        column(lambda k: span[k][0], np.int32), column(lambda k: span[k][1], np.int32), column(lambda k: number[balls[k][1]], np.int32), column(lambda k: number[balls[k][2]], np.int32),
        column(lambda k: balls[k][3], np.int64), column(lambda k: balls[k][4], np.int64), column(lambda k: balls[k][5], np.float64),
    )


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] numbers) for each i."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def owners(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray], int]:
    """(balls wholly owned by an entry, and it), (other points, and theirs), and how many distances of points were taken. Nearest by squared distance, of
    equal ones the entry that comes first.

    Balls go down level by level. A ball inherits its parent's list of entries; an entry leaves it if another is nearer to every point of the ball."""
    exact = entries.astype(np.float64)
    apart = np.sqrt(((exact[:, None] - exact) ** 2).sum(axis=2))
    first_of_equal = ~np.tril(apart == 0, -1).any(axis=1)
    scale = float(max(np.abs(tree.points).max(), np.abs(entries).max(), 1)) ** 2
    balls, lists = np.zeros(1, np.int64), first_of_equal[None, :]
    owned, leaves, leaf_lists = [], [np.zeros(0, np.int64)], [np.zeros((0, len(entries)), bool)]
    while len(balls):
        centre = tree.sums[balls] / tree.counts[balls, None]
        gap = ((centre[:, None] - exact) ** 2).sum(axis=2)
        best = np.where(lists, gap, np.inf).argmin(axis=1)
        least = np.take_along_axis(gap, best[:, None], axis=1)
        margin = 1e-9 * (gap + least) + 1e-12 * scale
        lists = lists & (gap - least <= 2 * tree.radius[balls, None] * apart[best] * (1 + 1e-9) + margin)
        alone = lists.sum(axis=1) == 1
        owned.append((balls[alone], best[alone]))
        leaf = ~alone & (tree.left[balls] < 0)
        leaves.append(balls[leaf])
        leaf_lists.append(lists[leaf])
        inner = ~alone & ~leaf
        balls, lists = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]]).astype(np.int64), np.tile(lists[inner], (2, 1))
    leaves, lists = np.concatenate(leaves), np.concatenate(leaf_lists)
    size = (tree.end - tree.start)[leaves].astype(np.int64)
    points, rows = ranges(tree.start[leaves].astype(np.int64), size), np.repeat(np.arange(len(leaves)), size)
    if not len(points):
        return owned, (points, points), 0
    at, entry = np.nonzero(lists[rows])
    gap = ((tree.points[points[at]].astype(np.int64) - entries[entry]) ** 2).sum(axis=1)
    begin = np.append(0, np.flatnonzero(np.diff(at)) + 1)
    least = np.minimum.reduceat(gap, begin)
    hits = np.flatnonzero(gap == least[at])
    return owned, (points, entry[hits[np.append(True, np.diff(at[hits]) > 0)]]), len(at)


def totals(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows of each entry: whole balls give what they have cached."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    owned, (points, own), _ = owners(tree, entries)
    for balls, entry in owned:
        np.add.at(sums, entry, tree.sums[balls])
        np.add.at(counts, entry, tree.counts[balls])
    np.add.at(sums, own, tree.points[points].astype(np.int64) * tree.weights[points, None])
    np.add.at(counts, own, tree.weights[points])
    return sums, counts


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each row, and its squared distance."""
    code = np.zeros(len(tree.points), np.int64)
    owned, (points, own), _ = owners(tree, entries)
    for balls, entry in owned:
        size = (tree.end - tree.start)[balls].astype(np.int64)
        code[ranges(tree.start[balls].astype(np.int64), size)] = np.repeat(entry, size)
    code[points] = own
    gap = ((tree.points.astype(np.int64) - entries[code]) ** 2).sum(axis=1)
    return code[tree.place], gap[tree.place]
