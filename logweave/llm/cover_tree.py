"""Cover trees over whole-number points, many at once, and nearest entries of a codebook by whole subtrees.

The trees are simplified cover trees.  A node of level l (2**l is the least power of two not under the distance
of its farthest point) holds its points within 2**l of its centre.  Its children are centres more than
2**(l-1) apart, each with the points within 2**(l-1) of it that no earlier child took; the first child keeps the centre.  A node
of few points, or of equal ones, is a leaf.  All nodes of a depth, of all trees, are split in the same numpy operations.

The points of a node are neighbours in the tree's order, so cumulative sums give the sum of any subtree by two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a node that is not split further.
LEAF = 24


def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All whole numbers of [a[0], b[0]), [a[1], b[1]), ... one after another."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _heads(keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _square(d: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Forest:
    order: np.ndarray      # places of the given points in the trees' order
    start: np.ndarray      # of each node: its points are order[start:end]
    end: np.ndarray
    centre: np.ndarray     # number of the point
    reach: np.ndarray      # squared distance of its farthest point
    child: np.ndarray      # first child; children are neighbours
    children: np.ndarray   # their number, 0 for a leaf
    trees: int             # the first nodes are the roots

    FIELDS = ("order", "start", "end", "centre", "reach", "child", "children")

    def pack(self) -> dict[str, bytes]:
        return {f: getattr(self, f).astype("<i8" if f == "reach" else "<i4").tobytes() for f in self.FIELDS}

    @classmethod
    def unpack(cls, packed: dict[str, bytes], trees: int) -> "Forest":
        return cls(*[np.frombuffer(packed[f], "<i8" if f == "reach" else "<i4").astype(np.int64) for f in cls.FIELDS], trees)


def build(points: np.ndarray, trees: int, leaf: int = LEAF) -> Forest:
    """One tree for each of ``trees`` equal stretches of ``points`` (whole numbers, a row each; a row or more a tree)."""
    n = len(points) // trees
    order = np.arange(len(points))
    root = np.arange(trees) * n
    reach = _square(points - np.repeat(points[root], n, axis=0)).reshape(trees, n).max(axis=1)
    start, end, centre, far = [root], [root + n], [root], [reach]
    child, children = [np.full(trees, -1)], [np.zeros(trees, np.int64)]
    first, total = 0, trees  # numbers of the nodes of this depth
    while True:
        node = first + np.flatnonzero((end[-1] - start[-1] > leaf) & (far[-1] > 0))
        if not len(node):
            break
        here = node - first
        a, b = start[-1][here], end[-1][here]
        at = ranges(a, b)
        owner = np.repeat(np.arange(len(node)), b - a)
        own = points[order[at]]
        level = np.ceil(np.log2(far[-1][here].astype(float)) / 2)
        near = np.repeat(np.exp2(2 * (level - 1)), b - a)  # squared distance that a child covers
        number = np.empty(len(at), np.int64)  # of the child within its node
        distance = np.empty(len(at), np.int64)
        heads_of, heads = [], []
        left, turn = np.arange(len(at)), 0
        while len(left):
            head = _heads(owner[left])
            who = owner[left[head]]
            middle = centre[-1][here] if turn == 0 else order[at[left[head]]]
            sizes = np.diff(np.append(head, len(left)))
            d = _square(own[left] - np.repeat(points[middle], sizes, axis=0))
            inside = d <= near[left]
            number[left[inside]], distance[left[inside]] = turn, d[inside]
            heads_of.append(who)
            heads.append(middle)
            left, turn = left[~inside], turn + 1
        put = np.lexsort((number, owner))
        order[at] = order[at[put]]
        key = (owner * turn + number)[put]
        head = _heads(key)
        sizes = np.diff(np.append(head, len(key)))
        start.append(at[head])
        end.append(at[head] + sizes)
        far.append(np.maximum.reduceat(distance[put], head))
        turns = np.repeat(np.arange(turn), [len(w) for w in heads_of])
        centre.append(np.concatenate(heads)[np.lexsort((turns, np.concatenate(heads_of)))])
        count = np.bincount(np.concatenate(heads_of), minlength=len(node))
        child[-1][here], children[-1][here] = total + np.cumsum(count) - count, count
        child.append(np.full(len(head), -1))
        children.append(np.zeros(len(head), np.int64))
        first, total = total, total + len(head)
    return Forest(order, *map(np.concatenate, (start, end, centre, far, child, children)), trees)


def assign(forest: Forest, points: np.ndarray, books: np.ndarray):
    """Nearest entries of each tree's codebook (``books``: trees x entries x width), ties to the lower number.

    Returns (starts, ends, entries) of stretches of ``forest.order``, and (places, entries) of single places
    for the points that were compared one by one; together they hold every point once.

    A node keeps an entry while it can be nearest to one of its points: the distance from the node's centre is at most
    that of the nearest entry plus twice the node's reach.  With one entry left the whole subtree has it; others descend.
    """
    trees, entries, width = books.shape
    flat = books.reshape(-1, width)
    node = np.repeat(np.arange(trees), entries)
    entry = np.arange(trees * entries)  # tree * entries + number
    reach = np.sqrt(forest.reach.astype(float))
    spans, places = [], []
    while len(node):
        d2 = _square(points[forest.centre[node]] - flat[entry])
        head = _heads(node)
        sizes = np.diff(np.append(head, len(node)))
        d = np.sqrt(d2.astype(float))
        bound = np.minimum.reduceat(d, head) + 2 * reach[node[head]]
        keep = d <= np.repeat(bound * (1 + 1e-9) + 1e-9, sizes)
        # Equal points have one answer at once.
        rank = d2 * entries + entry % entries
        flat_node = np.repeat(forest.reach[node[head]] == 0, sizes)
        keep &= ~flat_node | (rank == np.repeat(np.minimum.reduceat(rank, head), sizes))
        node, entry = node[keep], entry[keep]
        head = _heads(node)
        sizes = np.diff(np.append(head, len(node)))
        single = sizes == 1
        one = head[single]
        spans.append((forest.start[node[one]], forest.end[node[one]], entry[one] % entries))
        open_ = np.repeat(~single, sizes)
        leaf = open_ & (forest.children[node] == 0)
        if leaf.any():
            places.append(_compare(forest, points, flat, entries, node[leaf], entry[leaf]))
        node, entry = node[open_ & ~leaf], entry[open_ & ~leaf]
        if len(node):  # every child of a node with every entry of the node
            head = _heads(node)
            sizes = np.diff(np.append(head, len(node)))
            up = node[head]
            kids = forest.children[up]
            below = ranges(forest.child[up], forest.child[up] + kids)
            begin, n = np.repeat(head, kids), np.repeat(sizes, kids)
            node, entry = np.repeat(below, n), entry[ranges(begin, begin + n)]
    return _columns(spans, 3), _columns(places, 2)


def _columns(parts: list, n: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n)]


def _compare(forest, points, flat, entries, node, entry):
    """Points of leaves with the entries that their leaf has left: (places, entries)."""
    head = _heads(node)
    sizes = np.diff(np.append(head, len(node)))
    up = node[head]
    count = forest.end[up] - forest.start[up]
    place = ranges(forest.start[up], forest.end[up])
    begin, n = np.repeat(head, count), np.repeat(sizes, count)
    pair = ranges(begin, begin + n)
    rank = _square(np.repeat(points[forest.order[place]], n, axis=0) - flat[entry[pair]]) * entries + entry[pair] % entries
    best = np.minimum.reduceat(rank, np.cumsum(n) - n)
    return place, best % entries
