"""Cover trees over integer points (numpy), for assigning many points at once to their nearest centres."""

from __future__ import annotations

import numpy as np

LEAF = 12


class CoverTree:
    """Points in an order in which every node is a range of it.

    A node has a centre, one of its points, and a radius that reaches all of them. The points of a node at scale s are given to children of scale
    s / 2: the node's own centre first, then each point that lies further than s / 2 from all children so far, so children are that far apart.
    Nodes of at most ``LEAF`` points, or of equal points, have no children. Running sums over the order give any node's sum.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> None:
        self.points, self.order, self.nodes = points, order, nodes  # points are in the tree's order
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        order = np.arange(n)
        made: list[list[int]] = []  # low, high, centre's place, squared radius, first child, children
        if n:
            made.append([0, n, 0, 0, 0, 0])
        reach = [float(_squares(points, points[0]).max())] if n else []  # squared scale that covers the node
        i = 0
        while i < len(made):
            low, high, _, _, _, _ = node = made[i]
            own = order[low:high]
            away = _squares(points[own], points[own[0]])
            node[2], node[3] = low, int(away.max())
            if high - low > LEAF and node[3] > 0:
                scale = min(reach[i], float(node[3])) / 4
                groups, left = [], np.arange(high - low)
                while len(left):
                    near = away[left] <= scale
                    groups.append(own[left[near]])
                    left = left[~near]
                    if len(left):
                        away[left] = _squares(points[own[left]], points[own[left[0]]])
                order[low:high] = np.concatenate(groups)
                node[4], node[5], at = len(made), len(groups), low
                for g in groups:
                    made.append([at, at + len(g), 0, 0, 0, 0])
                    reach.append(scale)
                    at += len(g)
            i += 1
        return cls(points[order], order.astype(np.int32), np.array(made, np.int64).reshape(-1, 6))

    def assign(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centre of each point in the tree's order, sums per centre, counts per centre); ties go to the lower index.

        From the root down, a node whose nearest centre is closer than any other by more than twice its radius gives it to all its points, by the
        triangle inequality; only nodes that stay open hand on to their children, and points of open leaves are compared one by one.
        """
        nearest = np.zeros(len(self.points), np.int32)
        sums, counts = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        front, alone = np.arange(min(1, len(self.nodes))), []
        while len(front):
            low, high, place, radius, child, children = self.nodes[front].T
            away = _all_squares(self.points[place], centres)
            best = away.argmin(axis=1)
            first = away[np.arange(len(front)), best]
            away[np.arange(len(front)), best] = np.iinfo(np.int64).max
            second = away.min(axis=1) if len(centres) > 1 else np.full(len(front), np.iinfo(np.int64).max)
            gap = np.sqrt(second.astype(float)) - np.sqrt(first.astype(float))
            settled = (radius == 0) | (gap * (1 - 1e-9) - 1e-6 > 2 * np.sqrt(radius.astype(float)) * (1 + 1e-9)) | (len(centres) == 1)
            a, z, b = low[settled], high[settled], best[settled]
            nearest[_ranges(a, z)] = np.repeat(b, z - a)
            np.add.at(sums, b, self.sums[z] - self.sums[a])
            np.add.at(counts, b, z - a)
            leaf = ~settled & (children == 0)
            alone.append(_ranges(low[leaf], high[leaf]))
            down = ~settled & (children > 0)
            front = _ranges(child[down], child[down] + children[down])
        alone = np.concatenate(alone) if alone else np.zeros(0, np.int64)
        for a in range(0, len(alone), 4096):
            at = alone[a : a + 4096]
            b = _all_squares(self.points[at], centres).argmin(axis=1)
            nearest[at] = b
            np.add.at(sums, b, self.points[at])
            counts += np.bincount(b, minlength=len(centres))
        return nearest, sums, counts


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((points - centre) ** 2).sum(axis=1)


def _all_squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(centres)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - centres[None, :, d]) ** 2
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    size = high - low
    if not size.sum():
        return np.zeros(0, np.int64)
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
