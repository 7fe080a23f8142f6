"""MoJo of small tables in plain Python, which the operators are held against."""

import numpy as np
import pandas as pd


def largest_matching(edges: list[tuple[int, int]]) -> int:
    """Size of a maximum bipartite matching (augmenting paths)."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    owner: dict[int, int] = {}  # column -> row
    mate: dict[int, int] = {}  # row -> column

    def grow(start: int) -> bool:
        todo, came = [start], {}
        while todo:
            a = todo.pop()
            for b in out[a]:
                if b in came:
                    continue
                came[b] = a
                if b not in owner:
                    while b is not None:  # flip the path back to the start
                        a = came[b]
                        owner[b], mate[a], b = a, b, mate.get(a)
                    return True
                todo.append(owner[b])
        return False

    return sum(grow(a) for a in list(out))


def mojo_distance(n: np.ndarray) -> int:
    """Moves and joins that turn the row partition into the column partition: n is the contingency table."""
    if not n.size:
        return 0
    best = n.max(1)
    edges = [(i, int(j)) for i in range(len(n)) for j in np.flatnonzero(n[i] == best[i])]
    return int(n.sum() - best.sum()) + len(n) - largest_matching(edges)


def largest_mojo(columns: np.ndarray) -> int:
    """The distance of the worst partition, from the sizes of the target clusters."""
    groups = 0
    for size in np.sort(columns):
        groups += size > groups
    return int(columns.sum()) - int(groups)


def mojo_fm(table: pd.DataFrame) -> pd.DataFrame:
    """Without a mapped class 0; where every partition is as good as the reference, 100 for no distance and 0 else."""
    n = table.pivot_table(index="l", columns="r", values="n", fill_value=0, aggfunc="sum").to_numpy() if len(table) else np.zeros((0, 0))
    worst = largest_mojo(n.sum(0)) if n.size else 0
    d = mojo_distance(n)
    share = 0.0 if not n.size else (100.0 if d == 0 else 0.0) if worst <= 0 else min(100.0, max(0.0, 100.0 * (1 - d / worst)))
    return pd.DataFrame({"mojo": [d], "mojofm": [share]})
