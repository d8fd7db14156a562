"""Operator 6: embedding near-duplicates by a pivot-permutation index.

A vector is described by its LIST nearest reference points (pivots), nearest first, and stands in the inverted lists of
the POSTED nearest of them. Two vectors that meet in a list are compared if their descriptions share SHARED pivots; of
several lists only that of the smallest shared pivot counts the pair, so links are counted without being written out.

A posting carries the vector in 16-bit integers, which bounds its cosine to within some 1e-5. What is above or below
the threshold by more is settled in the list; the few pairs in between are verified in double precision on the vectors
themselves. Vectors of different dimensions never meet; each dimension has pivots of its own.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import giving_back, over_rows, stored, tidy
from .components import components

LIST, POSTED, SHARED = 8, 4, 2
#: Rows of one block of a crowded list, and of one tile of a block.
BLOCK, TILE = 8192, 256
#: The fit's bound: a dimension's pivots are picked among so many vectors and bytes, the least by hash.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
FULL = 32767


def pivot_count(n: int) -> int:
    """Grows with the square root of the rows, and lists with it; at most 8192."""
    return max(32, min(8192, round(4 * n**0.5)))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pick_pivots(sample: np.ndarray, count: int, apart: float = 0.9) -> np.ndarray:
    """The first `count` sampled unit vectors that are not near one another."""
    out = np.zeros((min(count, len(sample)), sample.shape[1]))
    n = 0
    for v in sample:
        if n == len(out):
            break
        if not n or np.max(out[:n] @ v) < apart:
            out[n] = v
            n += 1
    return out[:n]


def describe(vectors: np.ndarray, pivots: np.ndarray, size: int = LIST) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    size = min(size, len(pivots))
    near = -(vectors @ pivots.T)
    some = np.argpartition(near, size - 1, axis=1)[:, :size] if size < len(pivots) else np.tile(np.arange(size), (len(vectors), 1))
    return np.take_along_axis(some, np.lexsort((some, np.take_along_axis(near, some, 1)), axis=1), 1)


def packed(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit codes, their unit): component = code * unit, off by half a unit at most."""
    step = np.abs(unit).max(1) / FULL
    return np.rint(unit / step[:, None]).astype("<i2"), step


def _united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """parent (the least member of each one's group) after i and j have been joined pair by pair."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def compared(n: np.ndarray, x: np.ndarray, slack: np.ndarray, near: np.ndarray, left: np.ndarray | None, pivot: int, least: float):
    """Of the members of one block of the list of `pivot`: (weight of links, group, unsure pairs). With `left` only its
    members meet the others; the members' order is theirs, so a group is named by its first."""
    m = len(x)
    rows, cols = (np.arange(m),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    weight, parent, unsure = np.zeros(m, np.int64), np.arange(m), []
    need = min(SHARED, near.shape[1])
    for at in range(0, len(rows), TILE):
        r = rows[at : at + TILE]
        cos = x[r] @ x[cols].T
        hit = cos >= least - slack[r][:, None] - slack[cols][None, :]
        if left is None:
            hit &= cols[None, :] > r[:, None]
        a, b = np.nonzero(hit)
        for k in range(0, len(a), 50_000):
            p, q = a[k : k + 50_000], b[k : k + 50_000]
            i, j, c = r[p], cols[q], cos[p, q]
            same = near[i][:, :, None] == near[j][:, None, :]
            first = np.where(same[:, :POSTED, :POSTED].any(2), near[i][:, :POSTED], np.iinfo(near.dtype).max).min(1) == pivot
            good = first & (same.any(2).sum(1) >= need)
            i, j, c = i[good], j[good], c[good]
            sure = c >= least + slack[i] + slack[j]
            unsure.append((i[~sure], j[~sure]))
            i, j = i[sure], j[sure]
            weight += np.bincount(i, n[j], m).astype(np.int64) + np.bincount(j, n[i], m).astype(np.int64)
            parent = _united(parent, i, j)
    return weight, parent, unsure


def _classes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id and two hashes of the vector; classes: c, dim, rep, n, v and the hashes, one for each vector).

    The hashes are null for vectors that link with nothing. c is a number of the class, fixed by being stored."""
    kind = table.schema["embedding"].dataType
    one = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = table.select("vec_id", F.col("embedding").cast(f"array<{one}>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda a: a.isNotNull() & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    plain = F.when(F.coalesce(good, F.lit(False)), F.transform("v", lambda a: a + F.lit(0.0).cast(one)))  # -0.0 becomes 0.0
    rows = rows.withColumn("v", plain).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("g", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.reverse("v"))))
    classes = rows.where("v is not null").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return rows.select("vec_id", "h", "g"), stored(classes.select(F.monotonically_increasing_id().alias("c"), F.size("v").alias("dim"), "*"), "vectors")


def fit(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by dimension. Of each dimension at most SAMPLE vectors and SAMPLE_BYTES come to the driver."""
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    out = {}
    for dim, n in sorted(counts.items()):
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep", "h"), "c").limit(most).select("v").toPandas()["v"]
        out[dim] = pick_pivots(_unit(np.array(sample.tolist())), pivot_count(n))
    return out


@tidy
def near_duplicates(table: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs with cosine >= least in double precision.

    Null and zero vectors and vectors with null or non-finite components stay unlinked, and so do rows without an id;
    vectors of different dimensions don't link. Equal vectors are one class that is indexed once; each of its rows
    counts the others. Rows are vectors of their own also where they share a vec_id; a component is named by the
    smallest vec_id of its rows. An empty table gives an empty result. Pivots come from a bounded sample; every row is
    indexed. Retrieval misses a pair with no common list or fewer than SHARED common pivots: the README has its recall.
    """
    rows, classes = _classes(table)
    shared = table.sparkSession.sparkContext.broadcast(fit(classes))  # at most 8192 vectors a dimension

    def describing():
        def work(c, dim, n, v):
            out: dict[str, list] = {k: [] for k in ("c", "dim", "n", "code", "step", "near")}
            for d in sorted(set(dim)):
                at = [i for i, x in enumerate(dim) if x == d]
                x = _unit(np.array([v[i] for i in at]))
                code, step = packed(x)
                for k, got in zip(out, ([c[i] for i in at], [d] * len(at), [n[i] for i in at], [y.tobytes() for y in code], step.tolist(), describe(x, shared.value[d]).tolist())):
                    out[k] += got
            return out

        return work

    described = stored(over_rows(classes, ["c", "dim", "n", "v"], "c bigint, dim int, n bigint, code binary, step double, near array<int>", describing), "described")
    posts = described.withColumn("pivot", F.explode(F.slice("near", 1, POSTED)))
    lists = posts.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    met = posts.join(F.broadcast(lists), ["dim", "pivot"])  # a row a pivot
    met = met.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    met = met.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))))
    met = met.select("dim", "pivot", "to.i", "to.j", "own", "c", "n", "code", "step", "near").repartition("dim", "pivot", "i", "j").sortWithinPartitions("dim", "pivot", "i", "j", "c")

    import pyarrow as pa

    names = ["a", "n", "b", "sure"]

    def run(batches):
        def every():
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    yield from zip(*(x.to_pylist() for x in batch.slice(k, 1000).columns))

        for (dim, pivot, i, j), group in groupby(every(), key=lambda r: r[:4]):
            own, c, n, code, step, near = zip(*(r[4:] for r in group))
            if len(c) < 2:
                continue
            own, c, n, step, near = np.array(own), np.array(c, np.int64), np.array(n, np.int64), np.array(step), np.array(near, np.int32)
            x = np.frombuffer(b"".join(code), "<i2").reshape(-1, dim) * step[:, None]
            slack = step * (0.5 * dim**0.5 * 1.001) + 1e-12  # by Cauchy's inequality, for vectors of length 1 or hardly more
            weight, group_of, unsure = compared(n, x, slack * 1.001, near, None if i == j else own == i, pivot, least)
            some = np.flatnonzero(weight)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(weight[some]), pa.array(c[group_of[some]]), pa.array(np.ones(len(some), bool))], names=names)
            for p, q in unsure:
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(c[p]), pa.array(np.zeros(len(p), np.int64)), pa.array(c[q]), pa.array(np.zeros(len(p), bool))], names=names)

    found = stored(met.mapInArrow(giving_back(run), "a bigint, n bigint, b bigint, sure boolean"), "near")
    side = lambda k: classes.select(F.col("c").alias(k), F.col("v").alias(f"v_{k}"), F.col("n").alias(f"n_{k}")).hint("merge")
    open_ = found.where("not sure").select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def verifying():
        def work(a, b, v_a, v_b, n_a, n_b):
            keep = [k for k, (x, y) in enumerate(zip(v_a, v_b)) if float(_unit(np.array([x]))[0] @ _unit(np.array([y]))[0]) >= least]
            return {"a": [a[k] for k in keep], "n_b": [n_b[k] for k in keep], "b": [b[k] for k in keep], "n_a": [n_a[k] for k in keep]}

        return work

    exact = stored(over_rows(open_, ["a", "b", "v_a", "v_b", "n_a", "n_b"], "a bigint, n_b bigint, b bigint, n_a bigint", verifying), "exact")
    sure = found.where("sure").select("a", "n", "b")
    links = sure.unionAll(exact.select("a", "n_b", "b")).unionAll(exact.select("b", "n_a", "a"))
    counts = links.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    groups = components(links.select("a", "b")).withColumnRenamed("id", "c")
    named = classes.select("c", "h", "g", "rep", "n").join(counts.hint("merge"), "c", "left").join(groups.hint("merge"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = stored(named, "named")
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id.hint("merge"), "component").select("h", "g", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.join(named.hint("merge"), ["h", "g"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
