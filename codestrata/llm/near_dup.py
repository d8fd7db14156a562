"""Operator 4: MinHash near-duplicates with sequential Bayesian verification.

1. Every document gives the hash of its word sequence, the size of its set of word shingles and a MinHash signature.
   Documents with one sequence form a class; from here on its smallest doc_id stands for it.
2. Bands of the signature put classes into buckets. Each member of a bucket is paired with the bucket's smallest one.
3. Pairs are compared signature batch by batch. With a uniform prior the similarity has a Beta posterior after each
   batch; a pair goes once the chance that it reaches the threshold is below `miss`. Survivors are confirmed on their
   full sets of shingles.
4. Links give components. A bucket whose members lie in more than one component may still hide links that step 2 did
   not test; those members are compared across components, in blocks, each pair in the first bucket that it shares.
   What the posterior leaves of a block is verified in that block, the likeliest pair first, and a pair that earlier
   links have joined needs no test. So every pair of a bucket is in one component, pruned, or decided exactly, and
   what leaves a block are at most as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from hashlib import blake2b
from itertools import groupby
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, hashes_of, marked, mix, over_rows, shingles, stored, tidy, words
from .components import components

K = 5
HASHES = 128
BATCH = 16
MISS = 1e-6
BLOCK = 256


@cache
def bands(percent: int, hashes: int, miss: float) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold escapes all bands at most `miss` of the time."""
    t = percent / 100
    for r in range(hashes, 0, -1):
        if (1 - t**r) ** (hashes // r) <= miss:
            return hashes // r, r
    return hashes, 1


@cache
def floors(percent: int, hashes: int, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes seen, least matches) after each batch. P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, HASHES, np.uint64)


def signature(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """uint32 minima of so many functions over distinct shingle hashes, in blocks that fit the cache."""
    a, b = (x[:hashes] for x in _family())
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        out = np.minimum(out, (a[:, None] * s[None, i : i + 1024] + b[:, None]).min(1))
    return (out >> np.uint64(32)).astype("<u4")


def sketch(docs: DataFrame, count: int = HASHES) -> DataFrame:
    """(doc_id, key, n_shingles, sig) of every row; key and sig are null without words."""

    def make():
        def work(doc_id, text):
            out = {"doc_id": doc_id, "key": [], "n_shingles": [], "sig": []}
            for t in text:
                w = words(t)
                s = np.unique(shingles(hashes_of(w), K))
                out["key"].append(blake2b(b" ".join(w), digest_size=16).digest() if w else None)
                out["n_shingles"].append(len(s))
                out["sig"].append(signature(s, count).tobytes() if w else None)
            return out

        return work

    return over_rows(docs, ["doc_id", "text"], "doc_id bigint, key binary, n_shingles bigint, sig binary", make)


def _banded(classes: DataFrame, how: tuple[int, int, float]) -> DataFrame:
    n, r = bands(*how)
    hashes = how[1]

    def make():
        def work(rep, sig):
            m = np.frombuffer(b"".join(sig), "<u4").reshape(-1, hashes)[:, : n * r].astype(np.uint64).reshape(-1, n, r)
            h = np.arange(n, dtype=np.uint64)[None, :] + np.uint64(1)
            for i in range(r):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
            return {"bucket": h.ravel().view(np.int64), "band": np.tile(np.arange(n), len(rep)), "rep": np.repeat(np.array(rep, np.int64), n)}

        return work

    return over_rows(classes, ["rep", "sig"], "bucket bigint, band int, rep bigint", make)


def _alive(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, how: tuple[int, int, float]) -> np.ndarray:
    """Indices of the pairs of rows of a and b that no batch prunes; and their matches."""
    at = np.flatnonzero(100 * np.minimum(na, nb) >= how[0] * np.maximum(na, nb))
    got, done = np.zeros(len(at), int), 0
    for n, least in floors(*how[:2], min(how[2], MISS)):  # rarer bands don't loosen the pruning
        got += (a[at, done:n] == b[at, done:n]).sum(1)
        keep = got >= least
        at, got, done = at[keep], got[keep], n
    return at, got


def _pruned(pairs: DataFrame, classes: DataFrame, how: tuple[int, int, float]) -> DataFrame:
    """The pairs (a, b) that the posterior leaves."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")).hint("merge")
    met = pairs.join(side("a"), "a").join(side("b"), "b")

    def make():
        def work(a, b, sig_a, sig_b, n_a, n_b):
            x, y = (np.frombuffer(b"".join(s), "<u4").reshape(-1, how[1]) for s in (sig_a, sig_b))
            at, _ = _alive(x, y, np.array(n_a), np.array(n_b), how)
            return {"a": np.array(a)[at], "b": np.array(b)[at]}

        return work

    return over_rows(met, ["a", "b", "sig_a", "sig_b", "n_a", "n_b"], "a bigint, b bigint", make)


def grams(text: str | None) -> set[tuple[bytes, ...]]:
    """The full set of a text's shingles, as words."""
    w = words(text)
    return {tuple(w[i : i + K]) for i in range(max(1, len(w) - K + 1))} if w else set()


def _similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids, once each. A filter of fixed size drops most other texts before the shuffle."""
    few = marked(docs.select("doc_id", "text"), ids).where("maybe").drop("maybe")
    return few.join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _confirmed(pairs: DataFrame, texts_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs whose full sets of shingles, as words, meet the threshold."""
    texts = stored(texts_for(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "texts")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    met = pairs.join(side("b"), "b").join(side("a"), "a")

    def make():
        last: list = [None, None]

        def work(a, b, text_a, text_b):
            out = {"a": [], "b": []}
            for i, j, s, t in zip(a, b, text_a, text_b):
                if last[0] != i:
                    last[:] = i, grams(s)
                if _similar(last[1], grams(t), percent):
                    out["a"].append(i)
                    out["b"].append(j)
            return out

        return work

    return over_rows(met, ["a", "b", "text_a", "text_b"], "a bigint, b bigint", make)


def _runs(batches, key: str):
    """The rows of a sorted stream of Arrow batches, as lists of dicts with one key."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield from batch.slice(at, 1000).to_pylist()

    return groupby(rows(), key=lambda r: r[key])


def _blocks(banded: DataFrame, classes: DataFrame, found: DataFrame, how: tuple[int, int, float]) -> DataFrame:
    """(block, rep, component, pairs): the members of each block that have untested pairs across components, and on
    one row of the block these pairs, likeliest first, as numbers of its members in order. One component of a bucket
    counts as settled: its members meet the others, not each other."""
    rows = banded.select("bucket", "band", "rep").join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("main"), F.max("component").alias("other")).where("n > 2 and main != other").drop("other", "n")
    rows = rows.join(open_.hint("merge"), "bucket").withColumn("settled", F.col("component") == F.col("main")).drop("main")
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count_if("settled") / BLOCK).cast("int").alias("nt"), F.ceil(F.count_if(~F.col("settled")) / BLOCK).cast("int").alias("nx"))
    rows = rows.join(sizes.hint("merge"), "bucket").join(classes.select("rep", "sig", "n_shingles").hint("merge"), "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("settled"), F.col("nt")).otherwise(F.col("nx"))).cast("int"))
    each = lambda n, i, j: F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(i(x).alias("i"), j(x).alias("j")))
    mine = F.col("own")
    nothing = F.array().cast("array<struct<i:int,j:int>>")
    with_settled = F.when(F.col("nt") > 0, each(F.col("nt"), lambda x: mine, lambda x: -1 - x)).otherwise(nothing)
    among = each(F.col("nx"), lambda x: F.least(mine, x), lambda x: F.greatest(mine, x))
    to = F.when(F.col("settled"), each(F.col("nx"), lambda x: x, lambda x: -1 - mine)).otherwise(F.concat(with_settled, among))
    dealt = rows.withColumn("to", F.explode(to)).withColumn("block", F.xxhash64("bucket", "to.i", "to.j"))
    dealt = dealt.select("block", "band", "to.i", "to.j", "own", "settled", "component", "rep", "n_shingles", "sig").repartition("block").sortWithinPartitions("block")
    n_bands, r = bands(*how)

    import pyarrow as pa

    def compared(rows: list[dict]) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(x["sig"] for x in rows), "<u4").reshape(-1, how[1])
        n, comp = (np.array([x[k] for x in rows]) for k in ("n_shingles", "component"))
        band, first = rows[0]["band"], rows[0]
        if first["j"] < 0:
            left = np.array([not x["settled"] for x in rows])
        elif first["i"] != first["j"]:
            left = np.array([x["own"] == x["i"] for x in rows])
        else:
            left = None
        got: list[tuple[int, int, int]] = []
        for x in range(len(rows)):  # one row against the rest: the block's memory stays linear
            ys = np.arange(x + 1, len(rows)) if left is None else np.flatnonzero(~left) if left[x] else ys_none
            ys = ys[comp[ys] != comp[x]]
            if len(ys) and band:  # a pair belongs to the first band that it shares
                lower = (sig[x, : band * r] == sig[ys, : band * r]).reshape(len(ys), band, r).all(2).any(1)
                ys = ys[~lower]
            if len(ys):
                at, likes = _alive(np.broadcast_to(sig[x], (len(ys), how[1])), sig[ys], np.full(len(ys), n[x]), n[ys], how)
                got += zip((-likes).tolist(), [x] * len(at), ys[at].tolist())
        return [(x, y) for _, x, y in sorted(got)]

    ys_none = np.zeros(0, np.int64)

    def run(batches):
        for block, rows in _runs(batches, "block"):
            rows = list(rows)
            pairs = compared(rows)
            if pairs:
                used = sorted({k for p in pairs for k in p}, key=lambda k: rows[k]["rep"])
                number = {k: i for i, k in enumerate(used)}
                packed = np.array([(number[x], number[y]) for x, y in pairs], "<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(used), pa.int64()), pa.array([rows[k]["rep"] for k in used], pa.int64()), pa.array([rows[k]["component"] for k in used], pa.int64()), pa.array([packed] + [None] * (len(used) - 1), pa.binary())], names=["block", "rep", "component", "pairs"])

    return dealt.mapInArrow(giving_back(run), "block bigint, rep bigint, component bigint, pairs binary")


def _across(blocks: DataFrame, texts_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) that join the components of each block's members, confirmed on full sets."""
    texts = texts_for(blocks.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    met = blocks.join(texts.hint("merge"), "rep").repartition("block").sortWithinPartitions("block", "rep")

    import pyarrow as pa

    def run(batches):
        for _, rows in _runs(batches, "block"):
            rows = list(rows)
            pairs = np.frombuffer(next(x["pairs"] for x in rows if x["pairs"]), "<i4").reshape(-1, 2).tolist()
            root = {x["component"]: x["component"] for x in rows}
            sets: dict[int, set] = {}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            def of(k: int) -> set:
                if k not in sets:
                    sets[k] = grams(rows[k]["text"])
                return sets[k]

            out = []
            for x, y in pairs:
                p, q = top(rows[x]["component"]), top(rows[y]["component"])
                if p != q and _similar(of(x), of(y), percent):
                    root[max(p, q)] = min(p, q)
                    out.append((rows[x]["rep"], rows[y]["rep"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return met.mapInArrow(giving_back(run), "a bigint, b bigint").distinct()


@tidy
def near_duplicates(docs: DataFrame, percent: int = 80, hashes: int = HASHES, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links are shingle sets with 100 * shared >= percent * union.

    Null and empty texts and texts of white space alone have the empty set and are linked with nothing, so each stays.
    A row without doc_id can't be named in a link: it stays, with a null component. Repeated rows with one doc_id are
    one member. A class of copies, however large, is one vertex; joins on bands and keys are plain equi-joins that
    adaptive execution splits; a crowded bucket is compared in blocks of BLOCK rows.
    """
    return grouped(stored(sketch(docs, hashes), "sketch"), lambda ids: texts_of(docs, ids), percent, hashes, miss)


def grouped(every: DataFrame, texts_for: Callable[[DataFrame], DataFrame], percent: int, hashes: int, miss: float) -> DataFrame:
    """The steps after sketching. every: a stored sketch; texts_for(ids) gives (doc_id, text) of ids, once each."""
    how = (percent, hashes, miss)
    rows = every.where("key is not null and doc_id is not null")
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = rows.withColumn("rep", F.col("doc_id")).join(keys.hint("merge"), ["key", "rep"]).dropDuplicates(["key", "rep"]).select("rep", "n_shingles", "sig")
    members = _banded(reps, how)
    crowded = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("bucket", "a")
    banded = stored(members.join(crowded.hint("merge"), "bucket"), "banded")
    classes = stored(reps.join(banded.select("rep").distinct().hint("merge"), "rep", "left_semi"), "classes")
    stars = banded.where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    links = stored(_confirmed(stored(_pruned(stars, classes, how), "pairs"), texts_for, percent), "links")
    found = stored(components(links), "found")
    blocks = stored(_blocks(banded, classes, found, how), "blocks")
    if not blocks.isEmpty():
        links = stored(links.unionAll(_across(blocks, texts_for, percent)), "links")
        found = stored(components(links), "found")
    named = keys.join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("component"))
    out = every.select("doc_id", "key", "n_shingles").join(named.hint("merge"), F.col("key") == F.col("k"), "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that have a near-duplicate of smaller doc_id in their group."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    gone, maybe = stored(gone, "gone"), "__maybe"
    rows = marked(docs, gone, maybe)
    left = rows.where(maybe).join(gone.hint("merge"), "doc_id", "left_anti")
    return rows.where(~F.col(maybe)).select(docs.columns).unionAll(left.select(docs.columns))
