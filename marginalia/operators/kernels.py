"""Sequential graph and null-model kernels, one group to a call, by ``applyInPandas``.

They take graphs over a vocabulary, whose size a threshold upstream bounds; repetitions and sources run in
parallel.  What a kernel can't hold is refused, not cut: ``LARGEST`` edges.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import pairing
from .rounds import written

LARGEST = 2_000_000


def _one(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    ship(df.sparkSession)
    n = df.count()
    if n > LARGEST:
        raise ValueError(f"{n} edges are too many for a sequential kernel: raise the threshold that makes them")
    return df.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(lambda p: fn(p.drop(columns="__g")), ddl)


def adjacency(pdf: pd.DataFrame) -> tuple[list, dict[int, dict[int, float]]]:
    """Sorted nodes and symmetric neighbour weights of (src, tgt, weight)."""
    nodes = sorted(set(pdf["src"]) | set(pdf["tgt"]))
    at = {x: i for i, x in enumerate(nodes)}
    near: dict[int, dict[int, float]] = {i: {} for i in range(len(nodes))}
    for s, t, w in zip(pdf["src"], pdf["tgt"], pdf.get("weight", pd.Series(1.0, index=pdf.index)), strict=True):
        if s != t:
            a, b = at[s], at[t]
            near[a][b] = near[b][a] = max(float(w), near[a].get(b, 0.0))
    return nodes, near


def dependencies(near: dict[int, dict[int, float]], source: int, weighted: bool) -> np.ndarray:
    """How many shortest paths from the source depend on each node; distances are 1, or 1 / weight."""
    n = len(near)
    dist, paths, before, order = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
    dist[source], paths[source], heap, done = 0.0, 1.0, [(0.0, source)], np.zeros(n, bool)
    while heap:
        d, v = heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for w, weight in near[v].items():
            step = d + (1 / weight if weighted else 1.0)
            if step < dist[w] - 1e-12:
                dist[w], paths[w], before[w] = step, paths[v], [v]
                heappush(heap, (step, w))
            elif abs(step - dist[w]) <= 1e-12 and not done[w]:
                paths[w] += paths[v]
                before[w].append(v)
    share = np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + share[w])
    share[source] = 0
    return share


def centrality(edges: DataFrame, blocks: int = 16) -> DataFrame:
    """(node, betweenness, weighted_betweenness, eigenvector): sources in blocks, each block a task; sums by Spark."""
    ship(edges.sparkSession)
    n = edges.count()
    if n > LARGEST:
        raise ValueError(f"{n} edges are too many for a sequential kernel: raise the threshold that makes them")
    spread = edges.select("src", "tgt", "weight", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        nodes, near = adjacency(pdf)
        plain, heavy = np.zeros(len(nodes)), np.zeros(len(nodes))
        for s in range(block, len(nodes), blocks):
            plain += dependencies(near, s, False)
            heavy += dependencies(near, s, True)
        vector = power(near) if block == 0 else np.zeros(len(nodes))
        return pd.DataFrame({"node": nodes, "b": plain, "w": heavy, "e": vector})

    parts = spread.groupBy("block").applyInPandas(run, "node string, b double, w double, e double")
    out = parts.groupBy("node").agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("e").alias("eigenvector"))
    size = out.agg(F.count("*").alias("n"))
    pairs = F.nullif(((F.col("n") - 1) * (F.col("n") - 2)).cast("double"), F.lit(0.0))
    return out.join(F.broadcast(size)).select("node", (F.col("b") / 2).alias("betweenness"), F.coalesce(F.col("w") / pairs, F.lit(0.0)).alias("weighted_betweenness"), "eigenvector")


def power(near: dict[int, dict[int, float]], most: int = 200, close: float = 1e-12) -> np.ndarray:
    """Leading eigenvector of the weights, of unit length, by at most ``most`` steps."""
    n = len(near)
    rows = np.repeat(np.arange(n), [len(near[i]) for i in range(n)])
    cols = np.array([j for i in range(n) for j in near[i]], np.int64)
    w = np.array([x for i in range(n) for x in near[i].values()])
    v = np.full(n, 1 / np.sqrt(max(1, n)))
    for _ in range(most):
        new = v + np.bincount(rows, w * v[cols], n)  # the shift by v keeps two-sided graphs from swinging
        new /= max(np.linalg.norm(new), 1e-300)
        if np.abs(new - v).sum() < close:
            return new
        v = new
    return v


def merge_greedily(near: dict[int, dict[int, float]], link_share: float = 0.5) -> list[int]:
    """Modules by merging the pair of largest gain until none is positive.

    A merge gains ``link_share`` times links / m, less 2 degrees' product / (2 m)^2: 1 is the standard modularity
    gain, 0.5 (the default) the form that merges less.
    """
    n = len(near)
    between = {i: dict(near[i]) for i in range(n)}
    degree = {i: sum(near[i].values()) for i in range(n)}
    m2 = sum(degree.values())
    of = {i: [i] for i in range(n)}
    gain = lambda a, b: 2 * link_share * between[a][b] / m2 - 2 * degree[a] * degree[b] / (m2 * m2)
    heap = [(-gain(a, b), a, b) for a in between for b in between[a] if a < b] if m2 else []
    heap.sort()
    version = dict.fromkeys(range(n), 0)
    heap = [(g, a, b, 0, 0) for g, a, b in heap]
    while heap:
        g, a, b, va, vb = heappop(heap)
        if a not in of or b not in of or version[a] != va or version[b] != vb:
            continue
        if -g <= 1e-12:
            break
        of[a] += of.pop(b)
        degree[a] += degree.pop(b)
        version[a] += 1
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + w
        for c in between[a]:
            x, y = min(a, c), max(a, c)
            heappush(heap, (-gain(x, y), x, y, version[x], version[y]))
    label = [0] * n
    for k, (_, members) in enumerate(sorted(of.items(), key=lambda kv: (-len(kv[1]), min(kv[1])))):
        for i in members:
            label[i] = k + 1
    return label


def greedy_modules(edges: DataFrame, link_share: float = 0.5) -> DataFrame:
    """(node, module): modules numbered by size, then by least node (GRA-11)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, near = adjacency(pdf)
        return pd.DataFrame({"node": nodes, "module": merge_greedily(near, link_share)})

    return _one(edges, run, "node string, module long")


def greedy_cover(edges: DataFrame) -> DataFrame:
    """(step, node, covered): in each step the node that completes most relations, the first by name among equals (GRA-23)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(s, t) for s, t in zip(pdf["src"], pdf["tgt"], strict=True)]
        of: dict[str, list[int]] = {}
        for r, (s, t) in enumerate(pairs):
            of.setdefault(s, []).append(r)
            if t != s:
                of.setdefault(t, []).append(r)
        missing = [1 if s == t else 2 for s, t in pairs]
        gain = {x: sum(missing[r] == 1 for r in rs) for x, rs in of.items()}
        left, out, covered = set(of), [], 0
        while left:
            node = min(left, key=lambda x: (-gain[x], -len(of[x]), x))
            left.remove(node)
            for r in of[node]:
                missing[r] -= 1
                if missing[r] == 0:
                    covered += 1
                else:
                    other = pairs[r][0] if pairs[r][1] == node else pairs[r][1]
                    gain[other] += 1
            out.append((len(out) + 1, node, covered))
        return pd.DataFrame(out, columns=["step", "node", "covered"])

    return _one(edges, run, "step long, node string, covered long")


def capped_graph(edges: DataFrame, most: int = 12) -> DataFrame:
    """REL-15: (src, tgt, weight): nodes in order of name each take their strongest edges, at most ``most`` new ones;
    an edge that an earlier node took is passed over and uses nothing up.  The order is the operator, so it is sequential."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, near = adjacency(pdf)
        taken, out = set(), []
        for a in range(len(nodes)):
            left = most
            for b, w in sorted(near[a].items(), key=lambda kv: (-kv[1], kv[0])):
                if left and (min(a, b), max(a, b)) not in taken:
                    taken.add((min(a, b), max(a, b)))
                    out.append((nodes[a], nodes[b], w))
                    left -= 1
        return pd.DataFrame(out, columns=["src", "tgt", "weight"])

    return _one(edges, run, "src string, tgt string, weight double")


def curveball(units: list[set], trades: int, rng: np.random.Generator) -> list[set]:
    """Unit sets after random trades: every unit keeps its size and every item its frequency."""
    out = [set(u) for u in units]
    for _ in range(trades if len(out) > 1 else 0):
        i, j = rng.choice(len(out), 2, replace=False)
        common, free = out[i] & out[j], sorted(out[i] ^ out[j])
        if free:
            pick = rng.permutation(len(free))[: len(out[i]) - len(common)]
            mine = {free[k] for k in pick}
            out[i], out[j] = common | mine, common | (set(free) - mine)
    return out


def all_trade(units: np.ndarray, items: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The units (0 up to n - 1) of rows (unit, item) after all units have met in twos and traded: a round of half as
    many trades as units.  Every unit keeps its size and every item its frequency."""
    n = int(units.max()) + 1 if len(units) else 0
    at = rng.permutation(n)
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    duo, side = place[units] >> 1, place[units] & 1
    order = np.lexsort((items, duo))
    twin = (duo[order][1:] == duo[order][:-1]) & (items[order][1:] == items[order][:-1])  # an item that both hold stays
    both = np.zeros(len(units), bool)
    both[order[1:]] |= twin
    both[order[:-1]] |= twin
    free = np.flatnonzero(~both)
    free = free[np.lexsort((rng.random(len(free)), duo[free]))]
    d = duo[free]
    quota = np.bincount(d, side[free] == 0, minlength=n // 2 + 1).astype(np.int64)
    first = np.searchsorted(d, d)
    out = units.copy()
    out[free] = at[2 * d + (np.arange(len(d)) - first >= quota[d])]
    return out


def traded_pairs(inc: DataFrame, reps: int, rounds: int = 4, seed: int = 1, block: int = 1_000_000) -> DataFrame:
    """(rep, a, b, k): pair counts of (unit_seq, item) after rounds in which all units trade in twos (RES-4).

    Units meet within blocks of about ``block`` rows, dealt anew in each round, so a task holds one block at any size.
    """
    ship(inc.sparkSession)
    known = written(inc.groupBy("item").agg(F.count("*").alias("c")).select("item", "c", (F.row_number().over(Window.orderBy("item")) - 1).cast("int").alias("id")))  # a vocabulary
    size = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    v, blocks = size.v, 1 + size.n // block
    rows = written(inc.join(known.select("item", "id"), "item").select("unit_seq", "id")).select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), "unit_seq", "id")

    def dealt(r: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rep, at = int(pdf["rep"].iloc[0]), int(pdf["block"].iloc[0])
            pdf = pdf.sort_values(["unit_seq", "id"])
            names, units = np.unique(pdf["unit_seq"].to_numpy(), return_inverse=True)
            items = pdf["id"].to_numpy().astype(np.int64)
            units = all_trade(units, items, np.random.default_rng([seed, rep, r, at]))
            if r + 1 < rounds:
                return pd.DataFrame({"rep": np.int32(rep), "unit_seq": names[units], "id": items.astype(np.int32)})
            order = np.lexsort((items, units))
            ids, none = items[order], np.zeros(len(items), np.int64)
            found = [pairing.summed(np.sort(k)) for k in pairing.made(ids, none, none[: len(names)], np.bincount(units), v, 1)]
            keys, ks = (np.concatenate([f[i] for f in found] or [none]) for i in (0, 1))
            return pd.DataFrame({"rep": np.int32(rep), "x": (keys // 3 // v).astype(np.int32), "y": (keys // 3 % v).astype(np.int32), "k": ks})

        return run

    for r in range(rounds):
        hashed = F.pmod(F.xxhash64(F.lit(seed), "rep", F.lit(r), "unit_seq"), F.lit(blocks)).cast("int")
        rows = rows.withColumn("block", hashed).groupBy("rep", "block").applyInPandas(dealt(r), "rep int, unit_seq long, id int" if r + 1 < rounds else "rep int, x int, y int, k long")
    end = lambda of, to: known.select(F.col("id").alias(of), F.col("item").alias(to))
    return rows.groupBy("rep", "x", "y").agg(F.sum("k").alias("k")).join(end("x", "a"), "x").join(end("y", "b"), "y").select("rep", "a", "b", "k")


def swap_edges(edges: list[tuple], swaps: int, rng: np.random.Generator) -> list[tuple]:
    """Directed edges after random swaps of targets: degrees stay, no loop and no edge twice."""
    out, have = list(edges), set(edges)
    for _ in range(swaps if len(out) > 1 else 0):
        i, j = rng.choice(len(out), 2, replace=False)
        (a, b), (c, d) = out[i], out[j]
        if a != d and c != b and (a, d) not in have and (c, b) not in have:
            have -= {(a, b), (c, d)}
            have |= {(a, d), (c, b)}
            out[i], out[j] = (a, d), (c, b)
    return out


def grown(nodes: int, edges: int, back: float, close: float, power_: float, rng: np.random.Generator) -> set[tuple[int, int]]:
    """A directed graph grown edge by edge: an edge answers one, closes a path of two, or attaches by degree (RES-12)."""
    out: list[tuple[int, int]] = []
    have: set[tuple[int, int]] = set()
    degree = np.ones(nodes)
    tries = 0
    while len(out) < edges and tries < 50 * edges:
        tries += 1
        u = rng.random()
        if out and u < back:
            a, b = out[rng.integers(len(out))][::-1]
        elif out and u < back + close:
            a, m = out[rng.integers(len(out))]
            nexts = [t for s, t in out if s == m]
            if not nexts:
                continue
            b = nexts[rng.integers(len(nexts))]
        else:
            p = degree**power_
            a, b = rng.choice(nodes, 2, replace=False, p=p / p.sum())
        if a != b and (a, b) not in have:
            have.add((int(a), int(b)))
            out.append((int(a), int(b)))
            degree[a] += 1
            degree[b] += 1
    return have


def repeated(df: DataFrame, reps: int, fn: Callable[[pd.DataFrame, np.random.Generator], pd.DataFrame], ddl: str, seed: int = 1) -> DataFrame:
    """One kernel run a repetition, each with a generator of its own seed, in parallel."""
    ship(df.sparkSession)
    n = df.count()
    if n > LARGEST:
        raise ValueError(f"{n} rows are too many for a sequential kernel")
    spread = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = int(pdf["rep"].iloc[0])
        out = fn(pdf.drop(columns="rep").sort_values(list(pdf.columns.drop("rep"))).reset_index(drop=True), np.random.default_rng([seed, rep]))
        return out.assign(rep=rep)

    return spread.groupBy("rep").applyInPandas(run, f"{ddl}, rep int")
