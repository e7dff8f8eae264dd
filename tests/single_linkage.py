"""Single linkage and selection in one place, to compare with."""

import numpy as np
import pandas as pd

LEAST_DISTANCE = 1e-12


def merge_tree(edges: pd.DataFrame, least_size: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """The clusters of the least size or more, from a spanning tree's edges (a, b, w), and the one that each point falls into.

    cluster, parent, split, end, n, lam: ``split`` is the distance under which a cluster falls into two
    (NaN: never), ``end`` that at which it joins another (infinite for the last), n its points that fall
    right into it, and lam the sum of their 1 / distance.
    """
    up: dict[int, int] = {}
    held: dict[int, tuple[int | None, list[int]]] = {}  # root: cluster, or the points of a component that is none yet
    tree: list[list] = []
    of: dict[int, int] = {}

    def root(x: int) -> int:
        if x not in up:
            up[x], held[x] = x, (None, [x])
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def fall(points: list[int], cluster: int, w: float) -> None:
        of.update(dict.fromkeys(points, cluster))
        tree[cluster][4] += len(points)
        tree[cluster][5] += len(points) / max(w, LEAST_DISTANCE)

    for e in edges.sort_values(["w", "a", "b"]).itertuples():
        x, y = root(int(e.a)), root(int(e.b))
        if x == y:
            continue
        (cx, px), (cy, py) = held.pop(x), held.pop(y)
        up[y] = x
        cluster, points = cx if cx is not None else cy, px + py
        if cx is not None and cy is not None:
            cluster = len(tree)
            tree.append([cluster, None, e.w, np.inf, 0, 0.0])
            for child in (cx, cy):
                tree[child][1], tree[child][3] = cluster, e.w
        elif cluster is None and len(points) >= least_size:
            cluster = len(tree)
            tree.append([cluster, None, np.nan, np.inf, 0, 0.0])
        if cluster is not None:
            fall(points, cluster, e.w)
            points = []
        held[x] = (cluster, points)
    return pd.DataFrame(tree, columns=["cluster", "parent", "split", "end", "n", "lam"]), of


def excess_of_mass(tree: pd.DataFrame) -> pd.DataFrame:
    """cluster, kept: for every cluster the one that is kept and holds it (null: none).

    ``tree`` is a merge tree with n and lam: points that fall right into the cluster, and the sum of their
    1 / distance. A cluster's stability is the sum over its points of 1 / distance of leaving, less
    1 / distance of its end. From below, a cluster is kept if it is as stable as the kept ones in it.
    """
    at = {int(r.cluster): r for r in tree.itertuples()}
    kids: dict[int, list[int]] = {c: [] for c in at}
    for c, r in at.items():
        if not pd.isna(r.parent):
            kids[int(r.parent)].append(c)
    order, stack = [], [c for c, r in at.items() if pd.isna(r.parent)]
    while stack:
        order.append(stack.pop())
        stack += kids[order[-1]]
    size: dict[int, int] = {}
    best: dict[int, float] = {}
    chosen: set[int] = set()
    for c in reversed(order):
        r = at[c]
        below = sum(size[k] for k in kids[c])
        ends, splits = 1 / max(r.end, LEAST_DISTANCE), 1 / max(r.split, LEAST_DISTANCE) if kids[c] else 0.0
        size[c] = int(r.n) + below
        stability = r.lam - r.n * ends + below * (splits - ends)
        inner = sum(best[k] for k in kids[c])
        if not kids[c] or stability >= inner:
            chosen.add(c)
        best[c] = max(stability, inner) if kids[c] else stability
    kept: dict[int, int | None] = {}
    for c in order:
        above = None if pd.isna(at[c].parent) else kept[int(at[c].parent)]
        kept[c] = above if above is not None else c if c in chosen else None
    return pd.DataFrame({"cluster": pd.array(list(kept), "Int64"), "kept": pd.array(list(kept.values()), "Int64")})
