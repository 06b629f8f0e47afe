"""A cover tree over one block of integer points, and assignment of whole subtrees.

A node covers its points within its radius; its children are centres of half that reach, the
node's own centre first, each point going to the first centre that covers it. Points are kept in
tree order, so every subtree is a range, and running sums give the sum of any subtree.

Distances are compared exactly, as integers, wherever points are: a subtree goes to one centre
only if the triangle inequality leaves no other centre for any point in it, with room for the
rounding of square roots. Ties therefore never arise in a subtree that is taken whole, but for
points that are all equal to the node's centre, and these are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points up to which a node is not cut further.
LEAF_POINTS = 24
#: Share of the distances allowed for rounding.
SLACK = 1e-9


@dataclass
class Tree:
    points: np.ndarray  # in tree order
    order: np.ndarray  # original row of each
    sums: np.ndarray  # running sums, one row more than points
    centre: np.ndarray  # per node, a row of points
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # first child, its brothers follow
    children: np.ndarray


def build(points: np.ndarray) -> Tree:
    """The tree of a block; ``points`` is an int64 matrix of at least one row."""
    exact = points.astype(np.float64)
    order = np.arange(len(points))
    centre, radius, begin, end, child, children = [0], [0.0], [0], [len(points)], [0], [0]
    node = 0
    while node < len(begin):
        b, e = begin[node], end[node]
        rows = order[b:e]
        middle = exact[rows[0]]
        away = np.sqrt(((exact[rows] - middle) ** 2).sum(axis=1))
        radius[node] = float(away.max()) * (1 + SLACK)
        if e - b > LEAF_POINTS and radius[node] > 0:
            reach = radius[node] / 2
            parts, left = [], rows
            while len(left):
                inside = away <= reach
                parts.append(left[inside])
                left = left[~inside]
                if len(left):
                    away = np.sqrt(((exact[left] - exact[left[0]]) ** 2).sum(axis=1))
            order[b:e] = np.concatenate(parts)
            child[node], children[node] = len(begin), len(parts)
            for part in parts:
                begin.append(b)
                centre.append(b)
                b += len(part)
                end.append(b)
                radius.append(0.0)
                child.append(0)
                children.append(0)
        node += 1
    placed = points[order]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, axis=0)])
    whole = [np.array(v, np.int32) for v in (centre, begin, end, child, children)]
    # The first point of a range is its node's centre: children keep the order of their parent.
    return Tree(placed, order.astype(np.int32), sums, whole[0], np.array(radius), *whole[1:])


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    sizes = end - begin
    return np.repeat(end - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


def assign(tree: Tree, entries: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Per entry the sum and number of its points, and how many points were compared one by one.

    ``codes``, if given, receives the entry of every point in tree order.
    """
    k = len(entries)
    total = np.zeros((k, tree.points.shape[1]), np.int64)
    number = np.zeros(k, np.int64)
    compared = 0
    nodes = np.zeros(1, np.int64)
    # Of equal entries the first wins every tie.
    open_to = np.zeros((1, k), bool)
    open_to[0, np.unique(entries, axis=0, return_index=True)[1]] = True
    while len(nodes):
        exact = squared(tree.points[tree.centre[nodes]], entries)
        exact[~open_to] = np.iinfo(np.int64).max
        nearest = exact.argmin(axis=1)
        away = np.sqrt(exact.astype(np.float64))
        reach = tree.radius[nodes]
        bound = (away[np.arange(len(nodes)), nearest] + 2 * reach) * (1 + SLACK) + SLACK
        open_to &= away <= bound[:, None]
        whole = (open_to.sum(axis=1) == 1) | (reach == 0)
        done, to = nodes[whole], nearest[whole]
        if len(done):
            b, e = tree.begin[done], tree.end[done]
            np.add.at(total, to, tree.sums[e] - tree.sums[b])
            np.add.at(number, to, e - b)
            if codes is not None:
                codes[_ranges(b, e)] = np.repeat(to, e - b)
        nodes, open_to = nodes[~whole], open_to[~whole]
        leaf = tree.children[nodes] == 0
        if leaf.any():
            b, e = tree.begin[nodes[leaf]], tree.end[nodes[leaf]]
            spots = _ranges(b, e)
            apart = squared(tree.points[spots], entries)
            apart[~np.repeat(open_to[leaf], e - b, axis=0)] = np.iinfo(np.int64).max
            to = apart.argmin(axis=1)
            np.add.at(total, to, tree.points[spots])
            number += np.bincount(to, minlength=k)
            compared += len(spots)
            if codes is not None:
                codes[spots] = to
        inner = nodes[~leaf]
        first, several = tree.child[inner], tree.children[inner]
        open_to = np.repeat(open_to[~leaf], several, axis=0)
        nodes = _ranges(first, first + several)
    return total, number, compared
