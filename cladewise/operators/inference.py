"""Tree building and likelihoods, one data set or tree per group.

Data sets are bounded by design, and Spark spreads them; the NumPy inside works on one of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGES = "ds long, node string, parent string, length double"


def by_data_set(df: DataFrame, *columns: str):
    """Data sets as groups, over all shuffle partitions: their work is far above what their bytes say, so small ones must not be merged into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(F.col("ds").alias("ds"), *columns).repartition(n, "ds").groupBy("ds")


def _square(pairs: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(pairs["i"]) | set(pairs["j"]))
    at = {n: k for k, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pairs["i"].map(at).to_numpy(), pairs["j"].map(at).to_numpy()
    d[i, j] = d[j, i] = pairs["d"].to_numpy()
    return names, d


def _room(d: np.ndarray) -> np.ndarray:
    """``d`` with room for the nodes that joins add, so that none of them copies it."""
    out = np.zeros((2 * len(d), 2 * len(d)))
    out[: len(d), : len(d)] = d
    return out


def joined(d: np.ndarray) -> tuple[list[tuple], list[np.ndarray], np.ndarray]:
    """Steps of neighbour joining, the nodes that each one finds, and the distances of all nodes by number.

    Joins the first pair of least criterion; lengths below zero become zero, after the other end's was taken.
    The nodes' distances stand close in one array, in order of their numbers, from which a step takes two and to whose end it adds one.
    """
    n, room, live, out, before = len(d), _room(d), np.arange(len(d)), [], []
    sub, low, places = np.array(d, float), np.tri(len(d), dtype=bool), np.arange(len(d))
    for new in range(n, 2 * n - 2):
        now = sub[:n, :n]
        s = now.sum(1)
        q = (n - 2) * now
        q -= s[:, None]
        q -= s
        np.copyto(q, np.inf, where=low[:n, :n])
        a, b = divmod(int(q.argmin()), n)
        if a >= b:
            raise ValueError("distances are not finite")
        d_ab, s_a, s_b = float(now[a, b]), float(s[a]), float(s[b])
        to_a = 0.5 * d_ab + (s_a - s_b) / (2 * (n - 2))
        out.append((int(live[a]), int(live[b]), new, n, d_ab, s_a, s_b, max(0.0, to_a), max(0.0, d_ab - to_a)))
        before.append(live)
        row = np.maximum(0.0, 0.5 * (now[a] + now[b] - d_ab))
        room[new, live] = room[live, new] = row
        keep = np.concatenate([places[:a], places[a + 1 : b], places[b + 1 : n]])
        sub[: n - 2, : n - 2] = now.take(keep, 0).take(keep, 1)
        sub[n - 2, : n - 2] = sub[: n - 2, n - 2] = row.take(keep)
        sub[n - 2, n - 2] = 0.0
        live = np.append(live.take(keep), new)
        n -= 1
    if n == 2:
        u, v = live.tolist()
        d_uv = float(room[u, v])
        out.append((u, v, 2 * len(d) - 2, 2, d_uv, d_uv, d_uv, d_uv / 2, d_uv / 2))
        before.append(live)
    return out, before, room


def joins(names: list, d: np.ndarray) -> list[tuple]:
    """Steps of neighbour joining: ``(u, v, w, n, d_uv, s_u, s_v, len_u, len_v)``, nodes as numbers from the taxa on."""
    return joined(d)[0]


def neighbour_joining(names: list, d: np.ndarray) -> list[tuple]:
    """``(node, parent, length)``; the last join is the root."""
    steps = joins(names, d)
    label = [f"t{n}" for n in names] + [f"_{step[2]:06d}" for step in steps[:-1]] + ["_root"]
    if not steps:
        return [(label[0], "_root", 0.0), ("_root", None, 0.0)]
    return [edge for u, v, w, *_, x, y in steps for edge in ((label[u], label[w], x), (label[v], label[w], y))] + [("_root", None, 0.0)]


def join_tape(distances: DataFrame) -> DataFrame:
    """The joins of each data set in order: ``ds, step, u, v, w, n, d_uv, s_u, s_v``; taxa bear the places of their sorted names."""
    columns = ["u", "v", "w", "n", "d_uv", "s_u", "s_v"]

    def each(pairs: pd.DataFrame) -> pd.DataFrame:
        steps = [s[:7] for s in joins(*_square(pairs))]
        return pd.DataFrame(steps, columns=columns).assign(ds=pairs["ds"].iloc[0], step=range(len(steps)))[["ds", "step", *columns]]

    return by_data_set(distances, "i", "j", "d").applyInPandas(each, "ds long, step int, u int, v int, w int, n int, d_uv double, s_u double, s_v double")


def midpoint(edges: list[tuple]) -> list[tuple]:
    """``(node, parent, length)`` with the root moved to the middle of the longest way between two leaves; a root that is left with one way on goes."""
    near: dict[str, list[tuple[str, float]]] = {}
    for node, parent, length in edges:
        if parent is not None and not pd.isna(parent):
            near.setdefault(node, []).append((parent, length))
            near.setdefault(parent, []).append((node, length))
    old = next(n for n, p, _ in edges if p is None or pd.isna(p))
    if len(near.get(old, [])) == 2:
        (a, x), (b, y) = near.pop(old)
        near[a] = [e for e in near[a] if e[0] != old] + [(b, x + y)]
        near[b] = [e for e in near[b] if e[0] != old] + [(a, x + y)]

    def ways(start: str) -> tuple[dict, dict]:
        far, before, todo = {start: 0.0}, {start: None}, [start]
        while todo:
            here = todo.pop()
            for there, length in near.get(here, []):
                if there not in far:
                    far[there], before[there] = far[here] + length, here
                    todo.append(there)
        return far, before

    tips = sorted(n for n, e in near.items() if len(e) == 1)
    if len(tips) < 2:
        return edges
    far, _ = ways(tips[0])
    one = max(tips, key=lambda n: (far[n], n))
    far, before = ways(one)
    other = max(tips, key=lambda n: (far[n], n))
    half, below = far[other] / 2, other
    while far[before[below]] > half:
        below = before[below]
    above = before[below]
    out, todo = [("_root", None, 0.0)], [(below, "_root", far[below] - half, above), (above, "_root", half - far[above], below)]
    while todo:
        node, parent, length, come = todo.pop()
        out.append((node, parent, length))
        todo += [(n, node, x, node) for n, x in near[node] if n != come]
    return out


def rerooted(trees: DataFrame) -> DataFrame:
    """``ds, node, parent, length`` of the trees of ``build_trees``, each with its root in the middle of its diameter."""

    def each(tree: pd.DataFrame) -> pd.DataFrame:
        edges = [(n, None if pd.isna(p) else p, x) for n, p, x in zip(tree["node"], tree["parent"], tree["length"])]
        return pd.DataFrame(midpoint(edges), columns=["node", "parent", "length"]).assign(ds=tree["ds"].iloc[0])[["ds", "node", "parent", "length"]]

    return by_data_set(trees, "node", "parent", "length").applyInPandas(each, _EDGES)


def upgma(names: list, d: np.ndarray) -> list[tuple]:
    """``(node, parent, length)`` of the average-linkage tree."""
    live, label, size, height, out = list(range(len(names))), [f"t{n}" for n in names], [1] * len(names), [0.0] * len(names), []
    d = _room(d)
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        sub[np.tril_indices(len(live))] = np.inf
        a, b = divmod(int(np.argmin(sub)), len(live))
        u, v, new = live[a], live[b], len(label)
        h = sub[a, b] / 2
        label.append(f"_{new:06d}")
        out += [(label[x], label[new], max(0.0, h - height[x])) for x in (u, v)]
        d[new, live] = d[live, new] = (size[u] * d[u, live] + size[v] * d[v, live]) / (size[u] + size[v])
        size.append(size[u] + size[v])
        height.append(h)
        live = [x for x in live if x not in (u, v)] + [new]
    return out + [(label[live[0]], None, 0.0)]


def build_trees(distances: DataFrame, method: str = "nj") -> DataFrame:
    """A tree for each data set of ``distances(ds, i, j, d)``, as edges."""
    build = {"nj": neighbour_joining, "upgma": upgma}[method]

    def each(pairs: pd.DataFrame) -> pd.DataFrame:
        edges = build(*_square(pairs))
        return pd.DataFrame(edges, columns=["node", "parent", "length"]).assign(ds=pairs["ds"].iloc[0])[["ds", "node", "parent", "length"]]

    return by_data_set(distances, "i", "j", "d").applyInPandas(each, _EDGES)


def post_order(nodes: list, parents: list) -> list[int]:
    """Indices of nodes, children before parents."""
    at = {n: k for k, n in enumerate(nodes)}
    depth = {}

    def level(k: int) -> int:
        path = []
        while k not in depth and parents[k] is not None and not pd.isna(parents[k]):
            path.append(k)
            k = at[parents[k]]
        depth.setdefault(k, 0)
        for up in reversed(path):
            depth[up] = depth[at[parents[up]]] + 1
        return depth[path[0]] if path else depth[k]

    return sorted(range(len(nodes)), key=lambda k: -level(k))


def prune(edges: pd.DataFrame, tips: dict[str, np.ndarray], transition, root: np.ndarray) -> np.ndarray:
    """Log likelihood of each site by Felsenstein's pruning, scaled against underflow.

    ``tips`` gives (sites, states) partials by leaf; ``transition`` a matrix for a length.
    """
    nodes, parents, lengths = edges["node"].tolist(), edges["parent"].tolist(), edges["length"].tolist()
    partial: dict[str, np.ndarray] = {}
    log_scale = 0.0
    for k in post_order(nodes, parents):
        own = tips[nodes[k]] if nodes[k] in tips else partial.pop(nodes[k])
        top = own.max(axis=1, keepdims=True)
        log_scale = log_scale + np.log(top[:, 0])
        own = own / top
        if parents[k] is None or pd.isna(parents[k]):
            return np.log(own @ root) + log_scale
        message = own @ transition(lengths[k]).T
        partial[parents[k]] = partial[parents[k]] * message if parents[k] in partial else message
    raise ValueError("no root")


def jukes_cantor_matrix(t: float) -> np.ndarray:
    same = 0.25 + 0.75 * np.exp(-4.0 * t / 3.0)
    return np.full((4, 4), (1 - same) / 3) + np.eye(4) * (same - (1 - same) / 3)


def reversible(rates: tuple[float, ...], freqs: np.ndarray):
    """Transition matrices of a reversible model from its exchange rates (AC, AG, AT, CG, CT, GT) and frequencies, one change a unit of time expected."""
    q = np.zeros((4, 4))
    q[np.triu_indices(4, 1)] = rates
    q = (q + q.T) * freqs[None, :]
    q[range(4), range(4)] = -q.sum(1)
    q /= -(freqs * np.diag(q)).sum()
    root = np.sqrt(freqs)
    values, vectors = np.linalg.eigh(root[:, None] * q / root[None, :])
    left, right = vectors / root[:, None], vectors.T * root[None, :]
    return lambda t: np.maximum(0.0, (left * np.exp(values * t)) @ right)


def hky(kappa: float, freqs: np.ndarray):
    """Transitions (A-G, C-T) ``kappa`` times as likely as transversions."""
    return reversible((1, kappa, 1, 1, kappa, 1), freqs)


def barcode_matrix(t: float, edits: int, nu: float) -> np.ndarray:
    """States: unedited, the edits, silent."""
    m = np.zeros((edits + 2, edits + 2))
    m[range(edits + 1), range(edits + 1)] = np.exp(-nu * t)
    m[0, 0] = np.exp(-t * (1 + nu))
    m[0, 1 : edits + 1] = np.exp(-nu * t) * -np.expm1(-t) / edits
    m[: edits + 1, -1] = -np.expm1(-nu * t)
    m[-1, -1] = 1
    return m


def log_likelihood(edges: DataFrame, sequences: DataFrame, model: str = "jc", nu: float = 0.4, least: float = 1e-3, kappa: float = 4.0, rates: tuple[float, ...] = (1, 1, 1, 1, 1, 1)) -> DataFrame:
    """``ds, sites, log_likelihood`` of each data set's tree.

    ``jc``, ``hky`` and ``gtr`` take base codes (missing: all bases; the last
    two the data set's own frequencies), ``barcode`` barcode states (-1: silent). Lengths below ``least`` count as ``least``. ``edges`` name the taxon n as ``t`` and n.
    """

    def each(tree: pd.DataFrame, taxa: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(taxa):
            return pd.DataFrame({"ds": [], "sites": [], "log_likelihood": []})
        tree = tree.assign(length=np.maximum(tree["length"], least))
        seen = np.stack(taxa["codes"].to_list())
        leaves = set(tree["node"]) - set(tree["parent"].dropna())
        alone = sorted(leaves ^ {f"t{n}" for n in taxa["taxon"]})
        if alone:
            raise ValueError(f"{alone[0]} is not both a leaf and a sequence in data set {tree['ds'].iloc[0]}")
        if model != "barcode":
            tips = {f"t{n}": np.where((c < 0)[:, None], 1.0, np.eye(4)[np.maximum(c, 0)]) for n, c in zip(taxa["taxon"], seen)}
            freqs = np.full(4, 0.25) if model == "jc" else (np.bincount(seen[seen >= 0], minlength=4) + 1.0) / ((seen >= 0).sum() + 4.0)
            move = {"jc": lambda: jukes_cantor_matrix, "hky": lambda: hky(kappa, freqs), "gtr": lambda: reversible(rates, freqs)}[model]()
            value = prune(tree, tips, move, freqs)
        else:
            edits = max(1, int(seen.max()))
            tips = {f"t{n}": np.eye(edits + 2)[np.where(c < 0, edits + 1, c)] for n, c in zip(taxa["taxon"], seen)}
            value = prune(tree, tips, lambda t: barcode_matrix(t, edits, nu), np.eye(edits + 2)[0])
        return pd.DataFrame({"ds": [tree["ds"].iloc[0]], "sites": [seen.shape[1]], "log_likelihood": [float(value.sum())]})

    return by_data_set(edges, "node", "parent", "length").cogroup(by_data_set(sequences, "taxon", "codes")).applyInPandas(each, "ds long, sites int, log_likelihood double")
