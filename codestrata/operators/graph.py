"""Call chains: which symbols a symbol reaches, forward or backward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CALL_TREE

#: Edges that a root's depth-first walk may hold in one task; beyond, the tree is found by rounds over all tasks.
WALK = 1 << 20
_LABEL = "array<struct<rank:bigint,dst:bigint>>"


def _edges(calls: DataFrame, backward: bool) -> DataFrame:
    src, dst = ("callee_symbol_id", "caller_symbol_id") if backward else ("caller_symbol_id", "callee_symbol_id")
    return calls.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("call_id").alias("rank"))


def reach(edges: DataFrame, roots: DataFrame, depth: int, store) -> DataFrame:
    """(root, node, depth): least number of steps from each root, for nodes within `depth` steps.

    edges: src, dst; roots: root. One join a step with the frontier alone; store(df, name) writes what a step has
    found and reads it back, so that lineage stays short and an executor's loss costs one step.
    """
    pairs = store(edges.select("src", "dst").distinct(), "pairs")  # once, not at every step
    seen = front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    for step in range(1, depth + 1):
        met = front.select("root", F.col("node").alias("src")).join(pairs, "src").select("root", F.col("dst").alias("node")).distinct()
        front = store(met.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(step)), f"step{step}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def depth_first(adjacency: dict[int, list[int]], root: int, depth: int) -> list[tuple]:
    """Preorder of the depth-first walk with one visited set for the whole walk; a node too deep isn't marked."""
    out: list[tuple] = []
    seen: set[int] = set()
    stack: list[tuple[int, int | None, tuple]] = [(root, None, ())]
    while stack:
        node, parent, path = stack.pop()
        if len(path) > depth or node in seen:
            continue
        seen.add(node)
        path = (*path, node)
        out.append((root, node, parent, len(path) - 1, len(out), list(path)))
        stack += [(x, node, path) for x in reversed(adjacency.get(node, ()))]
    return out


def call_chain(calls: DataFrame, symbols: DataFrame, roots: DataFrame, store, direction: str = "forward", depth: int = 5, mode: str = "dfs") -> DataFrame:
    """The call tree of each root that is a known symbol (schema.CALL_TREE).

    mode "dfs" is the depth-bounded walk whose result depends on order; "bfs" gives the nodes by least depth, with
    null parent and path. For dfs the breadth-first reach first cuts each root's subgraph down to the edges that the
    walk can use. A root's subgraph of at most WALK edges is walked in one task; larger ones give the same rows by _tree().
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    edges = _edges(calls, direction == "backward")
    known = symbols.select("symbol_id")
    roots = store(roots.select("root").distinct().join(known.withColumnRenamed("symbol_id", "root"), "root", "left_semi"), "roots")
    near = reach(edges, roots, depth, store)
    if mode == "bfs":
        null = lambda t: F.lit(None).cast(t)
        return near.select("root", F.col("node").alias("node_id"), null("bigint").alias("parent_id"), "depth", null("int").alias("preorder"), null("array<bigint>").alias("path"))
    real = known.withColumnRenamed("symbol_id", "dst")
    pairs = edges.join(real, "dst", "left_semi").groupBy("src", "dst").agg(F.coalesce(F.min("rank"), F.lit((1 << 63) - 1)).alias("rank"))
    pairs = store(pairs, "ranked")
    used = near.where(F.col("depth") < depth).select("root", F.col("node").alias("src"))
    if _most(used, pairs) > WALK:
        return _tree(pairs, used, roots, depth, store)
    rows = _subgraphs(used, pairs, roots)

    def walk(key, pdf):
        import pandas as pd

        out = pd.DataFrame(_walked(pdf, int(key[0]), depth), columns=CALL_TREE.names)
        out["parent_id"] = out["parent_id"].astype("Int64")
        return out

    return rows.groupBy("root").applyInPandas(walk, CALL_TREE)


def _most(used: DataFrame, pairs: DataFrame) -> int:
    """The most edges that one root's walk can use."""
    held = used.join(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src")
    return held.groupBy("root").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _subgraphs(used: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    null = F.lit(None).cast("bigint")
    rows = used.join(pairs, "src").select("root", "src", "dst", "rank")
    return rows.unionByName(roots.select("root", F.col("root").alias("src"), null.alias("dst"), null.alias("rank")))


def _walked(pdf, root: int, depth: int) -> list[tuple]:
    adjacency: dict[int, list[int]] = {}
    for x in pdf.dropna(subset=["dst"]).sort_values(["src", "rank", "dst"]).itertuples():
        adjacency.setdefault(int(x.src), []).append(int(x.dst))
    return depth_first(adjacency, root, depth)


def _tree(pairs: DataFrame, used: DataFrame, roots: DataFrame, depth: int, store) -> DataFrame:
    """The depth-first call trees (schema.CALL_TREE) of roots whose subgraphs are too large for one task.

    A node's label is its tree path, as the (rank, dst) of its edges. The walk meets edges in the order of their labels,
    a path before what extends it, so a node has the least label of all edges to it from nodes above `depth`. Nodes
    without calls of their own change no other's label: labels are settled among the callers first (_labels), and all
    nodes take theirs in one pass. There the callers stand in for their labels by number; as a label may begin another,
    a node's least caller is found for each depth, and these few labels are compared. Preorder is the labels' order.
    """
    core = pairs.join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "rank")
    above = _ordered(_labels(store(core, "core"), used, roots, depth, store).where(F.size("label") < depth), store)
    above = store(above.withColumnRenamed("node", "src"), "above")
    met = above.select("root", "src", "seq", F.size("label").alias("depth")).join(pairs.select("src", "dst"), "src")
    least = met.groupBy("root", "dst").agg(*[F.min(F.when(F.col("depth") == k, F.col("seq"))).alias(f"s{k}") for k in range(depth)])
    some = least.select("root", "dst", F.explode(F.array_compact(F.array(*[f"s{k}" for k in range(depth)]))).alias("seq"))
    some = some.join(above, ["root", "seq"]).join(pairs, ["src", "dst"])
    every = _ordered(_least(some, roots), store)
    path = F.concat(F.array("root"), F.col("label.dst"))
    last = F.size("label")
    return every.select("root", F.col("node").alias("node_id"), F.when(last > 0, F.element_at(path, -2)).alias("parent_id"), last.alias("depth"), (F.col("seq") - 1).cast("int").alias("preorder"), path.alias("path"))


def _least(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, label): the least label of each node by the edges (root, label of src, dst, rank), and the roots'."""
    ends = edges.select("root", F.col("dst").alias("node"), F.concat("label", F.array(F.struct("rank", "dst"))).cast(_LABEL).alias("label"))
    start = roots.select("root", F.col("root").alias("node"), F.array().cast(_LABEL).alias("label"))
    return ends.union(start).groupBy("root", "node").agg(F.min("label").alias("label"))


def _labels(core: DataFrame, used: DataFrame, roots: DataFrame, depth: int, store) -> DataFrame:
    """(root, node, label) of the nodes that calls between callers (core) reach.

    Calls that fit in one task are walked there. Otherwise every round gives all nodes their least labels by those of the
    round before, until none changes. A label that all lesser ones have settled under is settled itself, so rounds end.
    """
    if _most(used, core) <= WALK:

        def walk(key, pdf):
            import pandas as pd

            rank = {(int(x.src), int(x.dst)): int(x.rank) for x in pdf.dropna(subset=["dst"]).itertuples()}
            rows = [(x[0], x[1], [rank[e] for e in zip(x[5], x[5][1:])], x[5][1:]) for x in _walked(pdf, int(key[0]), depth)]
            return pd.DataFrame(rows, columns=["root", "node", "ranks", "nodes"])

        rows = _subgraphs(used, core, roots).groupBy("root").applyInPandas(walk, "root bigint, node bigint, ranks array<bigint>, nodes array<bigint>")
        return store(rows.select("root", "node", F.arrays_zip("ranks", "nodes").cast(_LABEL).alias("label")), "labels")
    labels = store(roots.select("root", F.col("root").alias("node"), F.array().cast(_LABEL).alias("label")), "labels")
    while True:
        above = labels.where(F.size("label") < depth).select("root", F.col("node").alias("src"), "label")
        new = store(_least(above.join(core, "src"), roots), "labels")
        if new.count() == labels.count() and new.join(labels, ["root", "node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def _ordered(rows: DataFrame, store) -> DataFrame:
    """rows (root, node, label) with seq, each one's number from 1 in its root's order of labels; no task sorts a whole root."""
    dealt = store(rows, "unordered").repartitionByRange("root", "label").withColumn("part", F.spark_partition_id())
    dealt = store(dealt, "dealt")
    counts = dealt.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    row = F.row_number().over(Window.partitionBy("root", "part").orderBy("label"))
    placed = dealt.withColumn("row", row).join(counts.select("root", "part", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["root", "part"])
    return placed.select("root", "node", "label", (F.col("row") + F.col("ahead")).alias("seq"))


def nested(rows: list, names: dict[int, str] | None = None) -> dict | None:
    """A tree of dicts from one root's collected rows."""
    nodes: dict[int, dict] = {}
    top = None
    for r in sorted(rows, key=lambda r: r.preorder):
        nodes[r.node_id] = {"symbol_id": r.node_id, "name": (names or {}).get(r.node_id), "depth": r.depth, "children": []}
        if r.parent_id is None:
            top = nodes[r.node_id]
        else:
            nodes[r.parent_id]["children"].append(nodes[r.node_id])
    return top


def drawn(tree: dict, indent: str = "", last: bool = True, top: bool = True) -> list[str]:
    """Lines of a tree with connectors."""
    label = str(tree["name"] or tree["symbol_id"])
    lines = [label if top else f"{indent}{'└── ' if last else '├── '}{label}"]
    below = "" if top else indent + ("    " if last else "│   ")
    for k, child in enumerate(tree["children"]):
        lines += drawn(child, below, k == len(tree["children"]) - 1, False)
    return lines
