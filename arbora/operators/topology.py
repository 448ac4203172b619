"""Graph operators on trees: labels, distances, selections and edits of the parent links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import distance, per_neuron, with_parent
from .forest import Forest

_LINK = "neuron long, node_id long, parent_id long"


# --- labels --------------------------------------------------------------------------------------------------------
def classify_nodes(nodes: DataFrame) -> DataFrame:
    """Adds ``type``: root (no parent) wins, then by number of children: end, slab, branch."""
    kids = nodes.filter("parent_id >= 0").groupBy("neuron", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("__c"))
    t = nodes.join(kids, ["neuron", "node_id"], "left")
    kind = F.when((F.col("parent_id") < 0) | F.col("parent_id").isNull(), "root").when(F.col("__c").isNull(), "end").when(F.col("__c") == 1, "slab").otherwise("branch")
    return t.withColumn("type", kind).drop("__c")


def connected_components(nodes: DataFrame) -> DataFrame:
    """Component of each node: 0 is the neuron's largest; ties by smallest node id."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        t = f.frame(root=f.root)
        g = t.groupby("root", sort=False).agg(neuron=("neuron", "first"), n=("node_id", "size"), low=("node_id", "min")).reset_index()
        g = g.sort_values(["neuron", "n", "low"], ascending=[True, False, True])
        g["component"] = g.groupby("neuron").cumcount()
        return t.merge(g[["root", "component"]], on="root")[["neuron", "node_id", "component"]]

    return per_neuron(nodes, fn, "neuron long, node_id long, component long")


def child_lists(nodes: DataFrame) -> DataFrame:
    """Children of each node, in order; leaves have an empty list."""
    kids = nodes.filter("parent_id >= 0").groupBy("neuron", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("node_id")).alias("children"))
    return nodes.select("neuron", "node_id").join(kids, ["neuron", "node_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<long>")))


def tangents(nodes: DataFrame) -> DataFrame:
    """Midpoint, unit direction (child minus parent) and length of each edge; edges without length are left out."""
    e = with_parent(nodes, "x", "y", "z").withColumn("length", distance()).filter("length > 0")
    return e.select("neuron", F.col("node_id").alias("pid"), *(((F.col(c) + F.col(f"p{c}")) / 2).alias(c) for c in "xyz"), *(((F.col(c) - F.col(f"p{c}")) / F.col("length")).alias(f"v{c}") for c in "xyz"), "length")


def skeleton_edges(nodes: DataFrame) -> DataFrame:
    """Edges child to parent as positions in the order of node ids, from 0."""
    at = nodes.select("neuron", "node_id", "parent_id", (F.row_number().over(Window.partitionBy("neuron").orderBy("node_id")) - 1).cast("long").alias("child"))
    p = at.select("neuron", F.col("node_id").alias("parent_id"), F.col("child").alias("parent"))
    return at.join(p, ["neuron", "parent_id"]).select("neuron", "child", "parent")


def node_label_sorting(nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """Position of each node in a depth-first order that visits the child with the farthest leaf first (ties: smaller id)."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        d = f.dist_root if weighted else f.depth.astype(float)
        far, size = f.up(d, np.maximum), f.up(np.ones(f.n, np.int64))
        at = np.zeros(f.n, np.int64)
        roots = f.levels[0]
        order = np.lexsort((f.id[roots], -far[roots], f.neuron[roots]))
        for i, group in enumerate([roots[order], *f.levels[1:]]):
            key = f.neuron[group] if i == 0 else f.parent[group]
            group = group if i == 0 else group[np.lexsort((f.id[group], -far[group], key))]
            key = f.neuron[group] if i == 0 else f.parent[group]
            before = size[group].cumsum() - size[group]
            first = np.ones(len(group), bool)
            first[1:] = key[1:] != key[:-1]
            base = np.maximum.accumulate(np.where(first, before, 0))
            at[group] = before - base + (0 if i == 0 else at[f.parent[group]] + 1)
        return f.frame(position=at)

    return per_neuron(nodes, fn, "neuron long, node_id long, position long")


# --- distances -----------------------------------------------------------------------------------------------------
def _pairs(nodes: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
    """Nodes and what is asked of them (rows with a neuron) meet by neuron, in one shuffle and many whole neurons a call.

    ``fn`` gets the forest of the neurons that have rows, and the rows with the neurons' codes in it (``code``).
    """
    own = [c for c in ("neuron", "node_id", "parent_id", "x", "y", "z") if c in nodes.columns]
    asked = [c for c in pairs.columns if c != "neuron"]
    names = [f"__{c}" for c in asked]
    blank = lambda df, c: F.lit("" if dict(df.dtypes)[c] == "string" else 0).cast(dict(df.dtypes)[c])  # noqa: E731  no nulls: ids stay whole numbers
    a = nodes.select(*own, F.lit(0).alias("__kind"), *(blank(pairs, c).alias(n) for c, n in zip(asked, names)))
    b = pairs.select("neuron", *(blank(nodes, c).alias(c) for c in own[1:]), F.lit(1).alias("__kind"), *(F.col(c).alias(n) for c, n in zip(asked, names)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf["__kind"].to_numpy() == 1
        some, rest = pdf[rows], pdf[~rows]
        both = np.intersect1d(some["neuron"], rest["neuron"])
        if not len(both):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        some, rest = some[some["neuron"].isin(both)], rest[rest["neuron"].isin(both)]
        some = some[["neuron", *names]].set_axis(["neuron", *asked], axis=1).assign(code=np.searchsorted(both, some["neuron"]))
        return fn(Forest(rest[own].reset_index(drop=True)), some.reset_index(drop=True))

    return per_neuron(a.union(b), run, schema, order=("__kind", "node_id"), union=True)


def dist_between(nodes: DataFrame, pairs: DataFrame, directed: bool = False, max_dist: float | None = None) -> DataFrame:
    """Distance along the tree for pairs (neuron, a, b); infinite across components, in the wrong direction, beyond max_dist."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        zero = b["code"].to_numpy(np.int64)
        i, j = f.find(zero, b["a"].to_numpy(np.int64)), f.find(zero, b["b"].to_numpy(np.int64))
        ok = (i >= 0) & (j >= 0)
        b, i, j = b[ok], i[ok], j[ok]
        m, d = f.lca(i, j), f.dist_root
        dist = np.where(m >= 0, d[i] + d[j] - 2 * d[m], np.inf)
        if directed:
            dist[m != j] = np.inf
        if max_dist is not None:
            dist[dist > max_dist] = np.inf
        return b[["neuron", "a", "b"]].assign(dist=dist)

    return _pairs(nodes, pairs, fn, "neuron long, a long, b long, dist double")


def _upward(nodes: DataFrame, from_: DataFrame, to_: DataFrame, max_dist: float | None) -> DataFrame:
    """(neuron, a, b, dist) of each node of ``from_`` with those of ``to_`` on its way to the root, itself too: walks of as many steps as there are such pairs."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        at = f.find(b["code"].to_numpy(np.int64), b["asked"].to_numpy(np.int64))
        side = b["side"].to_numpy()
        starts, goals = (np.bincount(at[(at >= 0) & (side == k)], minlength=f.n) for k in (0, 1))
        above = np.full(f.n, -1)  # the nearest goal above each node
        for level in f.levels[1:]:
            p = f.parent[level]
            above[level] = np.where(goals[p] > 0, p, above[p])
        i = np.flatnonzero(starts)
        j, pairs, d = np.where(goals[i] > 0, i, above[i]), [], f.dist_root
        while len(i := i[j >= 0]):
            j = j[j >= 0]
            pairs.append((i, j))
            j = above[j]
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (i, i)
        dist = d[i] + d[j] - 2 * d[j]
        times = starts[i] * goals[j] * (dist <= (np.inf if max_dist is None else max_dist))
        return pd.DataFrame({"neuron": f.nodes["neuron"].to_numpy()[i], "a": f.id[i], "b": f.id[j], "dist": dist}).loc[np.repeat(np.arange(len(i)), times)]

    asked = from_.select("neuron", F.col("node_id").alias("asked"), F.lit(0).alias("side")).union(to_.select("neuron", "node_id", F.lit(1)))
    return _pairs(nodes, asked, fn, "neuron long, a long, b long, dist double")


def geodesic_matrix(nodes: DataFrame, from_: DataFrame | None = None, to_: DataFrame | None = None, finite: bool = False, **options) -> DataFrame:
    """dist_between of all (from, to) pairs of each neuron; ``from_`` and ``to_`` are tables (neuron, node_id).

    ``finite``: only pairs with a way; directed ones are then found along the tree, without a row for each pair.
    """
    own = nodes.select("neuron", "node_id")
    if finite and options.get("directed"):
        return _upward(nodes, from_ if from_ is not None else own, to_ if to_ is not None else own, options.get("max_dist"))
    if finite:
        return geodesic_matrix(nodes, from_, to_, **options).filter(F.col("dist") < float("inf"))
    a = (from_ if from_ is not None else own).select("neuron", F.col("node_id").alias("a"))
    b = (to_ if to_ is not None else own).select("neuron", F.col("node_id").alias("b"))
    return dist_between(nodes, a.join(b, "neuron"), **options)


def distal_to(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether a is distal to b: b lies on the way from a to its root (a itself counts)."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        zero = b["code"].to_numpy(np.int64)
        i, j = f.find(zero, b["a"].to_numpy(np.int64)), f.find(zero, b["b"].to_numpy(np.int64))
        ok = (i >= 0) & (j >= 0)
        return b[ok][["neuron", "a", "b"]].assign(distal=f.lca(i[ok], j[ok]) == j[ok])

    return _pairs(nodes, pairs, fn, "neuron long, a long, b long, distal boolean")


def connecting_nodes(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The fewest nodes that connect the chosen ones (neuron, node_id), per component."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(f.n, np.int64)
        at = f.find(b["code"].to_numpy(np.int64), b["node_id"].to_numpy(np.int64))
        own[at[at >= 0]] = 1
        below = f.up(own)
        total = below[f.root]
        best = np.zeros(f.n, np.int64)
        has = np.flatnonzero(f.parent >= 0)
        np.maximum.at(best, f.parent[has], below[has])
        # on a path between chosen nodes: some below, and not all of them below one child
        keep = (below > 0) & ((below < total) | (best < total))
        return f.frame(x=0)[keep][["neuron", "node_id"]]

    return _pairs(nodes, chosen, fn, "neuron long, node_id long")


# --- selections ----------------------------------------------------------------------------------------------------
def subset(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Only the nodes in ``keep`` (neuron, node_id), all columns; parents that are gone become -1."""
    ids = keep.select("neuron", "node_id").distinct()
    kept = nodes.join(ids, ["neuron", "node_id"], "left_semi")
    parents = ids.select("neuron", F.col("node_id").alias("parent_id"), F.lit(True).alias("__has"))
    return kept.join(parents, ["neuron", "parent_id"], "left").withColumn("parent_id", F.when(F.col("__has"), F.col("parent_id")).otherwise(F.lit(-1))).select(*nodes.columns)


def merge_subset(nodes: DataFrame, edited: DataFrame) -> DataFrame:
    """The edited rows in place of the nodes with their ids."""
    return nodes.join(edited.select("neuron", "node_id"), ["neuron", "node_id"], "left_anti").unionByName(edited, allowMissingColumns=True)


def _keep(nodes: DataFrame, fn) -> DataFrame:
    """Subset by a function of the forest that gives a mask."""
    mask = lambda pdf: (lambda f: f.frame(x=0)[fn(f)][["neuron", "node_id"]])(Forest(pdf))
    return subset(nodes, per_neuron(nodes, mask, "neuron long, node_id long"))


def longest_neurite(nodes: DataFrame, n: int = 1, inverse: bool = False) -> DataFrame:
    """The n longest paths of each neuron (or everything else), by length along the tree; ties by leaf id."""

    def mask(f: Forest) -> np.ndarray:
        rank = path_rank(f)
        return (rank >= n) if inverse else (rank < n)

    return _keep(nodes, mask)


def path_rank(f: Forest) -> np.ndarray:
    """Rank of each node's path among its neuron's, longest first."""
    leaf, d = f.paths(), f.dist_root
    top = np.flatnonzero((f.parent < 0) | (leaf[f.parent] != leaf))
    start = np.where(f.parent[top] < 0, d[top], d[f.parent[top]])
    own = leaf[top]
    t = pd.DataFrame({"leaf": own, "neuron": f.neuron[own], "id": f.id[own], "len": d[own] - start}).sort_values(["neuron", "len", "id"], ascending=[True, False, True])
    t["rank"] = t.groupby("neuron").cumcount()
    out = np.zeros(f.n, np.int64)
    out[t["leaf"].to_numpy()] = t["rank"].to_numpy()
    return out[leaf]


def split_neurites(nodes: DataFrame, n: int = 2) -> DataFrame:
    """Piece of each node: the subtree of each of the n longest paths, later ones first; piece 0 holds what is left."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        rank = path_rank(f)
        top = (f.parent < 0) | (rank[f.parent] != rank)
        piece = np.where(top & (rank < n) & (rank > 0), rank, -1)
        for level in f.levels:
            free = level[piece[level] < 0]
            piece[free] = np.where(f.parent[free] < 0, 0, piece[f.parent[free]])
        return f.frame(piece=piece)

    return per_neuron(nodes, fn, "neuron long, node_id long, piece long")


def prune_by_strahler(nodes: DataFrame, orders: list[int] | int) -> DataFrame:
    """Drops nodes of the given Strahler orders; a negative number drops all but the top ones."""

    def mask(f: Forest) -> np.ndarray:
        si = f.strahler()
        if isinstance(orders, int) and orders < 0:
            top = pd.Series(si).groupby(f.neuron).transform("max").to_numpy()
            return si > top + orders
        return ~np.isin(si, [orders] if isinstance(orders, int) else orders)

    return _keep(nodes, mask)


def prune_twigs(nodes: DataFrame, min_length: float, recursive: bool = False, exact: bool = False) -> DataFrame:
    """Drops terminal stretches shorter than ``min_length`` (``recursive``: until none is left; ``exact``: trims every
    tip by that length along the tree)."""

    def mask(f: Forest) -> np.ndarray:
        if exact:
            d = f.dist_root
            return f.up(np.where(f.children == 0, d, -np.inf), np.maximum) - d >= min_length
        keep = np.ones(f.n, bool)
        g, at = f, np.arange(f.n)
        while True:
            seg, d = g.segments(), g.dist_root
            own = np.flatnonzero(seg >= 0)
            p = g.parent[own]
            ends = (g.children[p] != 1) | (g.parent[p] < 0)
            length = np.zeros(g.n)
            length[seg[own[ends]]] = d[seg[own[ends]]] - d[p[ends]]
            twig = (seg >= 0) & (g.children[seg] == 0) & (length[seg] < min_length)
            # a stretch that reaches the root is the whole of its tree, not a twig
            to_branch = np.zeros(g.n, bool)
            to_branch[seg[own[ends]]] = g.children[p[ends]] > 1
            twig &= to_branch[seg]
            keep[at[twig]] = False
            if not recursive or not twig.any():
                return keep
            at = at[~twig]
            g = Forest(g.nodes[~twig].reset_index(drop=True))

    return _keep(nodes, mask)


def prune_at_depth(nodes: DataFrame, depth: float) -> DataFrame:
    """Nodes within a path length of their root."""
    return _keep(nodes, lambda f: f.dist_root <= depth)


def drop_fluff(nodes: DataFrame, min_size: int | None = None, n_largest: int | None = None) -> DataFrame:
    """Only components of at least ``min_size`` nodes, of these the ``n_largest`` (default: the largest)."""
    c = connected_components(nodes)
    size = c.groupBy("neuron", "component").agg(F.count("*").alias("n"))
    if min_size is not None:
        size = size.filter(F.col("n") >= min_size)
    if n_largest is not None or min_size is None:
        size = size.filter(F.col("component") < (n_largest or 1))
    return subset(nodes, c.join(size, ["neuron", "component"]))


def split_components(nodes: DataFrame, min_size: int = 1) -> DataFrame:
    """Nodes with ``component``, of components of at least ``min_size`` nodes."""
    c = connected_components(nodes)
    big = c.groupBy("neuron", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return nodes.join(c.join(big, ["neuron", "component"], "left_semi"), ["neuron", "node_id"])


def find_main_branchpoint(nodes: DataFrame, method: str = "longest_neurite", threshold: float = 0.95) -> DataFrame:
    """One node per neuron: where the second longest path leaves the longest, or, by ``betweenness`` from branch points, the
    node farthest from the root with at least ``threshold`` of the highest value."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        if method == "longest_neurite":
            rank = path_rank(f)
            top = np.flatnonzero((rank == 1) & (f.parent >= 0))
            top = top[rank[f.parent[top]] != 1]
            return f.frame(x=0).iloc[f.parent[top]][["neuron", "node_id"]].drop_duplicates("neuron")
        branch = ((f.children > 1) & (f.parent >= 0)).astype(np.int64)
        value, d = f.up(branch) - branch, f.dist_root
        high = pd.Series(value).groupby(f.neuron).transform("max").to_numpy()
        t = f.frame(value=value, d=d)[(value >= threshold * high) & (branch > 0)]
        return t.sort_values(["neuron", "d", "node_id"], ascending=[True, False, True]).drop_duplicates("neuron")[["neuron", "node_id"]]

    return per_neuron(nodes, fn, "neuron long, node_id long")


def cell_body_fiber(nodes: DataFrame, method: str = "longest_neurite", inverse: bool = False) -> DataFrame:
    """The way from the root to the main branch point (or everything else)."""
    main = find_main_branchpoint(nodes, method)

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        at = f.find(b["code"].to_numpy(np.int64), b["node_id"].to_numpy(np.int64))
        own = np.zeros(f.n, np.int64)
        own[at[at >= 0]] = 1
        way = f.up(own) > 0
        return f.frame(x=0)[~way if inverse else way][["neuron", "node_id"]]

    return subset(nodes, _pairs(nodes, main, fn, "neuron long, node_id long"))


# --- edits ---------------------------------------------------------------------------------------------------------
def reroot(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Turns the parent links between each new root (neuron, node_id) and its component's old root around."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        parent = f.nodes["parent_id"].to_numpy(np.int64).copy()
        links = f.parent.copy()
        for at in f.find(b["code"].to_numpy(np.int64), b["node_id"].to_numpy(np.int64)).tolist():
            before = -1
            while at >= 0:
                up = links[at]
                links[at], parent[at] = before, f.id[before] if before >= 0 else -1
                before, at = at, up
        return f.frame(parent_id=parent)

    turned = _pairs(nodes, roots, fn, _LINK).withColumnRenamed("parent_id", "__turned")
    return nodes.join(turned, ["neuron", "node_id"], "left").withColumn("parent_id", F.coalesce("__turned", "parent_id")).select(*nodes.columns)


def cut(nodes: DataFrame, where: DataFrame) -> DataFrame:
    """Cuts above each node (neuron, node_id): nodes with ``piece`` (the cut node's id distally, -1 for what stays with
    the old root). A cut node is in both pieces: root of the distal one, leaf of the proximal one. Roots are not cut."""

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        at = f.find(b["code"].to_numpy(np.int64), b["node_id"].to_numpy(np.int64))
        at = np.unique(at[at >= 0])
        at = at[f.parent[at] >= 0]
        is_cut = np.zeros(f.n, bool)
        is_cut[at] = True
        piece = np.full(f.n, -1, np.int64)
        for level in f.levels[1:]:
            piece[level] = np.where(is_cut[level], f.id[level], piece[f.parent[level]])
        parent = np.where(is_cut | (f.parent < 0), -1, f.id[f.parent])
        both = f.frame(parent_id=parent, piece=piece)
        again = f.frame(parent_id=f.id[f.parent], piece=piece[f.parent]).iloc[at]
        return pd.concat([both, again], ignore_index=True)

    pieces = _pairs(nodes, where, fn, _LINK + ", piece long")
    return nodes.drop("parent_id").join(pieces, ["neuron", "node_id"]).select(*nodes.columns, "piece")


def remove_nodes(nodes: DataFrame, which: DataFrame) -> DataFrame:
    """Without the given nodes (neuron, node_id); children go to the nearest ancestor that stays."""
    marked = nodes.join(which.select("neuron", "node_id", F.lit(True).alias("gone")).distinct(), ["neuron", "node_id"], "left").fillna(False, ["gone"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        gone = pdf["gone"].to_numpy(bool)
        near = f.parent.copy()
        for level in f.levels[1:]:
            up = f.parent[level]
            near[level] = np.where(gone[up], near[up], up)
        return f.frame(parent_id=np.where(near >= 0, f.id[near], -1))[~gone]

    links = per_neuron(marked.select("neuron", "node_id", "parent_id", "gone"), fn, _LINK)
    return nodes.drop("parent_id").join(links, ["neuron", "node_id"]).select(*nodes.columns)


def insert_nodes(nodes: DataFrame, where: DataFrame, fraction: float = 0.5) -> DataFrame:
    """A new node on the edge above each given node (neuron, node_id), ``fraction`` of the way to the parent; radii are
    interpolated, ids go on from each neuron's highest in the order of the given ids."""
    top = nodes.groupBy("neuron").agg(F.max("node_id").alias("top"))
    w = where.select("neuron", "node_id").distinct()
    e = with_parent(nodes, "x", "y", "z", "radius").join(w, ["neuron", "node_id"], "left_semi").filter("px IS NOT NULL").join(top, "neuron")
    e = e.withColumn("new", F.col("top") + F.row_number().over(Window.partitionBy("neuron").orderBy("node_id")))
    mixed = {c: F.col(c) * (1 - fraction) + F.col(f"p{c}") * fraction for c in ("x", "y", "z", "radius")}
    fresh = e.select("neuron", F.col("new").alias("node_id"), "parent_id", *(v.alias(c) for c, v in mixed.items()))
    moved = nodes.join(e.select("neuron", "node_id", "new"), ["neuron", "node_id"], "left").withColumn("parent_id", F.coalesce("new", "parent_id")).select(*nodes.columns)
    return moved.unionByName(fresh, allowMissingColumns=True)


def collapse_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Merges nodes to the target of their group (neuron, node_id, target); links within a group vanish."""
    g = groups.select("neuron", "node_id", "target")
    p = g.select("neuron", F.col("node_id").alias("parent_id"), F.col("target").alias("ptarget"))
    own = g.select("neuron", F.col("node_id"), F.col("target"))
    t = nodes.join(own, ["neuron", "node_id"], "left").join(p, ["neuron", "parent_id"], "left")
    t = t.withColumn("id", F.coalesce("target", "node_id")).withColumn("up", F.coalesce("ptarget", "parent_id"))
    links = t.groupBy("neuron", "id").agg(F.max(F.when((F.col("id") != F.col("up")) & (F.col("up") >= 0), F.col("up"))).alias("up"))
    base = nodes.join(own.filter("node_id <> target"), ["neuron", "node_id"], "left_anti").drop("parent_id")
    return base.join(links.select("neuron", F.col("id").alias("node_id"), F.coalesce("up", F.lit(-1)).alias("parent_id")), ["neuron", "node_id"]).select(*nodes.columns)


def merge_duplicate_nodes(nodes: DataFrame, digits: int | None = None) -> DataFrame:
    """Folds nodes at equal (rounded) places into the one with the smallest id."""
    at = [F.round(c, digits) if digits is not None else F.col(c) for c in "xyz"]
    w = Window.partitionBy("neuron", *at)
    return collapse_nodes(nodes, nodes.select("neuron", "node_id", F.min("node_id").over(w).alias("target")))


def health_check(nodes: DataFrame) -> DataFrame:
    """Per neuron: duplicate ids, parents that are missing, nodes at a place that another one has, several roots."""
    dup = nodes.groupBy("neuron", "node_id").agg(F.count("*").alias("n")).groupBy("neuron").agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    place = nodes.groupBy("neuron", "x", "y", "z").agg(F.count("*").alias("n")).groupBy("neuron").agg(F.sum(F.col("n") - 1).alias("duplicate_places"))
    lost = with_parent(nodes, "x").groupBy("neuron").agg(F.count_if((F.col("parent_id") >= 0) & F.col("px").isNull()).alias("missing_parents"), F.count_if(F.col("parent_id") < 0).alias("roots"))
    return dup.join(place, "neuron").join(lost, "neuron")


def simplify_graph(nodes: DataFrame) -> DataFrame:
    """Edges between roots, branch points and leaves with the path length between them."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        seg, d = f.segments(), f.dist_root
        own = np.flatnonzero(seg >= 0)
        p = f.parent[own]
        ends = (f.children[p] != 1) | (f.parent[p] < 0)
        s, top = seg[own[ends]], p[ends]
        return pd.DataFrame({"neuron": f.nodes["neuron"].to_numpy()[s], "source": f.id[s], "target": f.id[top], "length": d[s] - d[top]})

    return per_neuron(nodes, fn, "neuron long, source long, target long, length double")


def edges_to_forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Undirected edges (neuron, a, b) and roots (neuron, node_id) -> nodes with parents, breadth first; edges that
    would close a cycle are left out (ties: smaller ids first). Components without a root get their smallest node."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"neuron": b["neuron"], "node_id": b["node_id"], "parent_id": -1})
        ids = np.unique(np.concatenate([a["a"], a["b"], b["node_id"]]))
        i, j = np.searchsorted(ids, a["a"]), np.searchsorted(ids, a["b"])
        u, v = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        at = np.searchsorted(u, np.arange(len(ids) + 1))
        parent = np.full(len(ids), -2)
        for r in [*np.searchsorted(ids, np.sort(b["node_id"])).tolist(), *range(len(ids))]:
            if parent[r] != -2:
                continue
            parent[r], now = -1, [r]
            while now:
                nxt = []
                for x in now:
                    for y in v[at[x] : at[x + 1]].tolist():
                        if parent[y] == -2:
                            parent[y] = x
                            nxt.append(y)
                now = sorted(nxt)
        key = a["neuron"].iloc[0]
        return pd.DataFrame({"neuron": key, "node_id": ids, "parent_id": np.where(parent >= 0, ids[parent], -1)})

    e, r = (t.select(*(F.col(c).alias(c) for c in t.columns)) for t in (edges, roots))
    return e.groupBy("neuron").cogroup(r.groupBy("neuron")).applyInPandas(run, _LINK)


def geodesic_clusters(nodes: DataFrame, max_dist: float) -> DataFrame:
    """Greedy clusters: the node farthest from the root that is free seeds one, and takes what is free and within
    ``max_dist`` along free nodes."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        d, label, k = f.dist_root, np.full(f.n, -1), 0
        around = [[] for _ in range(f.n)]
        for c in np.flatnonzero(f.parent >= 0).tolist():
            around[c].append(int(f.parent[c]))
            around[f.parent[c]].append(c)
        start_of: dict[int, int] = {}
        for s in np.lexsort((f.id, -d, f.neuron)).tolist():
            if label[s] >= 0:
                continue
            own = f.neuron[s]
            k = start_of.get(own, 0)
            start_of[own] = k + 1
            label[s], todo = k, [(s, 0.0)]
            while todo:
                x, far = todo.pop()
                for y in around[x]:
                    far_y = far + abs(d[y] - d[x])
                    if label[y] < 0 and far_y <= max_dist:
                        label[y] = k
                        todo.append((y, far_y))
        return f.frame(cluster=label)

    return per_neuron(nodes, fn, "neuron long, node_id long, cluster long")


def propagate_labels(nodes: DataFrame, labels: DataFrame, max_iter: int = 1000, tol: int = 1) -> DataFrame:
    """Spreads labels (neuron, node_id, label) along the tree: each round a node takes the mean of its neighbours' label
    probabilities, seeds keep theirs; stops when fewer than ``tol`` nodes change their label."""

    def one(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(b["label"].astype(str))
        at = f.find(np.zeros(len(b), np.int64), b["node_id"].to_numpy(np.int64))
        prob = np.zeros((f.n, len(names)))
        ok = at >= 0
        prob[at[ok], np.searchsorted(names, b["label"].astype(str).to_numpy()[ok])] = 1
        seed, fixed = at[ok], prob[at[ok]].copy()
        c = np.flatnonzero(f.parent >= 0)
        p = f.parent[c]
        degree = np.maximum(f.children + (f.parent >= 0), 1)[:, None]
        before = np.full(f.n, -1)
        for _ in range(max_iter):
            new = np.zeros_like(prob)
            np.add.at(new, p, prob[c])
            np.add.at(new, c, prob[p])
            prob = new / degree
            prob[seed] = fixed
            now = np.where(prob.max(axis=1) > 0, prob.argmax(axis=1), -1)
            if (now != before).sum() < tol and (now >= 0).all():
                break
            before = now
        return f.frame(label=np.where(now >= 0, names[now], None))

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:  # each neuron stops by itself
        own = dict(tuple(b.groupby("code")))
        return pd.concat([one(Forest(n.reset_index(drop=True)), own[g]) for g, n in f.nodes.groupby(f.neuron)], ignore_index=True)

    return _pairs(nodes, labels, fn, "neuron long, node_id long, label string")
