"""Operator 3: mixing sources to target weights by hierarchical budgets.

A token budget flows down the tree domain - language - source. Each node splits its budget among its children by
weight, none above what its whole subtree can supply; what a full child can't take goes to its siblings by their
weights, and only what no sibling can take has been left to other branches, since a node is never given more than its
subtree holds. A leaf with S tokens and budget B gives all its documents B // S times and, of the next epoch in
seeded order, the longest prefix of whole documents within the B mod S tokens that remain.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEVELS = ["domain", "lang", "source"]
NONE = "(none)"
#: The most leaves that are broadcast: some 20 MB.
LEAVES = 100_000
#: Documents for which the seeded order has 16 more buckets; one bucket a leaf is put in order.
BUCKET = 50_000


def tokens(text: str) -> Column:
    """Tokens of a text for the budget: its words. Null counts as none."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def split(budget: Fraction, weights: dict, most: dict) -> dict:
    """budget by weight, none above its most; shortages go to the others by weight until the budget or all are spent."""
    out = {k: Fraction(0) for k in weights}
    free = [k for k in weights if weights[k] > 0 and most[k] > 0]
    left = min(budget, Fraction(sum(most[k] for k in free)))
    while free and left > 0:
        total = sum(Fraction(weights[k]) for k in free)
        full = [k for k in free if left * Fraction(weights[k]) / total >= most[k]]
        if not full:
            for k in free:
                out[k] = left * Fraction(weights[k]) / total
            break
        for k in full:
            out[k] = Fraction(most[k])
        left -= sum(Fraction(most[k]) for k in full)
        free = [k for k in free if k not in full]
    return out


def budgets(supply: dict[tuple, int], budget: int, weights: list[dict], epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf. supply: tokens by path; weights: by level, name -> weight (1 if it has none)."""
    below: dict[tuple, dict] = {}  # node -> child -> what the child's subtree can supply
    for leaf, n in supply.items():
        for depth, name in enumerate(leaf):
            children = below.setdefault(leaf[:depth], {})
            children[name] = children.get(name, 0) + n * epochs
    amounts: dict[tuple, Fraction] = {(): Fraction(budget)}
    for node in sorted(below, key=lambda p: (len(p), p)):
        shares = {k: Fraction(str(weights[len(node)].get(k, 1))) for k in sorted(below[node])}
        for k, x in split(amounts[node], shares, below[node]).items():
            amounts[(*node, k)] = x
    return {leaf: int(amounts[leaf]) for leaf in supply}


def decided(docs: DataFrame, domain: Column, weights: list[dict], budget: float = 0.8, epochs: int = 2, seed: int = 7) -> DataFrame:
    """docs, all columns as they are, with __domain, __n (tokens) and __copies (see copies())."""
    spark = docs.sparkSession
    leaf = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    path = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"__{k}") for k, c in leaf.items()]
    names = [f"__{k}" for k in LEVELS]
    short = stored(docs.select("doc_id", *path, tokens("text").alias("n")), "leaves")
    sums = {tuple(r[k] for k in names): (r.s, r.c) for r in short.groupBy(*names).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).collect()}
    total, rows = sum(s for s, _ in sums.values()), sum(c for _, c in sums.values())
    given = budgets({k: s for k, (s, _) in sums.items()}, int(Fraction(str(budget)) * total), weights, epochs)
    parts = min(1 << 16, rows // BUCKET * 16 + 64)  # small inputs have buckets too
    plan = [(*k, b // sums[k][0] if sums[k][0] else 0, b % sums[k][0] if sums[k][0] else 0) for k, b in given.items()]
    small = F.broadcast if len(plan) <= LEAVES else (lambda df: df)
    leaves = small(spark.createDataFrame(plan, ", ".join([*(f"{n} string" for n in names), "__full bigint", "__rest bigint"])))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.floor(F.conv(F.substring(F.col("__place"), 1, 8), 16, 10).cast("bigint") * parts / F.lit(1 << 32))
    ordered = short.join(leaves, names).where("__rest > 0").withColumn("__place", place).withColumn("__bucket", bucket)
    by_bucket = ordered.groupBy(*names, "__bucket", "__rest").agg(F.sum("n").alias("s"))
    upto = Window.partitionBy(*names).orderBy("__bucket")
    edge = by_bucket.withColumn("__before", F.sum("s").over(upto) - F.col("s")).where("__before <= __rest and __before + s > __rest").select(*names, F.col("__bucket").alias("__edge"), "__before")
    inside = ordered.join(edge, names).where("__bucket = __edge")
    along = Window.partitionBy(*names).orderBy("__place").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("__sum", F.sum("n").over(along) + F.col("__before")).where("__sum <= __rest").groupBy(*names).agg(F.max("__place").alias("__last"))
    firsts = inside.groupBy(*names).agg(F.min("__bucket").alias("__edge"))
    ends = {tuple(r[k] for k in names): (r["__edge"], r["__last"]) for r in firsts.join(last, names, "left").collect()}
    final = [(*row[:4], *ends.get(row[:3], (None, None))) for row in plan]
    ended = small(spark.createDataFrame(final, ", ".join([*(f"{n} string" for n in names), "__full bigint", "__edge bigint", "__last string"])))
    met = docs.withColumns({**{n: p for n, p in zip(names, path)}, "__n": tokens("text")}).join(ended, names, "left")
    met = met.withColumn("__place", place).withColumn("__bucket", bucket)
    extra = F.coalesce(F.when(F.col("__bucket") < F.col("__edge"), 1).when((F.col("__bucket") == F.col("__edge")) & (F.col("__place") <= F.col("__last")), 1), F.lit(0))
    return met.select(*docs.columns, "__domain", "__n", (F.coalesce("__full", F.lit(0)) + extra).cast("int").alias("__copies"))


def copies(docs: DataFrame, domain: Column, weights: list[dict], budget: float = 0.8, epochs: int = 2, seed: int = 7) -> DataFrame:
    """docs with domain, n_tokens and copies (0 or more): how many times the mix holds each document.

    budget: tokens of the mix as a share of all tokens. Null domains, languages and sources are a leaf "(none)" each.
    Texts without words cost nothing and are taken as often as their leaf's order says. Rows with equal doc_id, also
    those without one, have equal places in the order and are taken or left together. Columns of docs with the names of
    the three new ones give way to them. An empty table gives an empty result.

    The tree is the driver's: leaves, their sums, budgets and last keys come to it, some hundred bytes a leaf, and up to
    LEAVES leaves go to every task, so that documents are decided in place and no text is shuffled. With more leaves
    the texts are joined to them, which adaptive execution splits where a leaf is hot.
    """
    out = decided(docs, domain, weights, budget, epochs, seed)
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    return out.select(*own, F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"), F.col("__copies").alias("copies"))


#: The weights and the grouping of sources that the query and the pipeline use.
DOMAINS = {"web": range(0, 5), "news": range(5, 10), "books": range(10, 15), "forums": range(15, 20)}
WEIGHTS = [{"web": 0.4, "news": 0.2, "books": 0.25, "forums": 0.15}, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}, {}]


def domain_of(source: str = "source") -> Column:
    out = F.lit("other")
    for name, numbers in DOMAINS.items():
        out = F.when(F.col(source).isin([f"src{i}" for i in numbers]), name).otherwise(out)
    return out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as many times as copies() says. All columns stay as they are, whatever their names; null and empty
    texts, repeated rows, rows without doc_id and empty tables are as in copies()."""
    taken = decided(docs, domain_of(), WEIGHTS, **how).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
