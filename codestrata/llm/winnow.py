"""Operator 8: document fingerprints by winnowing, in DataFrame functions only.

The units are words, lower-cased runs between ASCII white space. In scripts that put no space between words every code
point is a unit, and so it is in runs of more than RUN code points, so that long and unspaced texts have units too.

A gram is K consecutive units. Its hash is the cyclic polynomial of the units' 64-bit hashes, a rolling hash: with
rotations to the left by one, h(i + 1) = rot(h(i)) xor rot^K(unit i) xor unit i + K. An array expression has no running
state, so the same sum is built unit by unit, all grams at once.

Of each window of W consecutive grams the least hash is kept, the rightmost of equals, with its position; hashes are
ordered by their first 31 bits. So any two texts that share K + W - 1 consecutive units share a fingerprint. A text of
fewer than K units is one gram, one of fewer than W grams is one window, and an empty text has no fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
W = 3
RUN = 24
#: Documents in a bucket of neighbours, and the buckets of a group of them (of as many groups at most).
BUCKET, GROUPS = 512, 256
_LOW = 0x7FFFFFFF
_SPACE = r"\x20\x09-\x0D"
#: Thai and Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_IN = f"[^{_SPACE}{_UNSPACED}]"
UNIT = f"[{_UNSPACED}]|{_IN}(?={_IN}{{{RUN}}})|(?<={_IN}{{{RUN}}}){_IN}|{_IN}{{1,{RUN}}}"


def _rotated(h: Column) -> Column:
    return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))


def _pairs(df: DataFrame, name: str, other: str, step: int, join) -> DataFrame:
    """Combines each value of an array with the one of `other` that is `step` further on; the array ends with it."""
    x, y = F.col(name), F.col(other)
    n = F.greatest(F.size(y) - step, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(step + 1), n), join))


def fingerprints(df: DataFrame, text: str, to: str, k: int = K, w: int = W) -> DataFrame:
    """Adds the arrays `to` (positions of the selected grams, in order) and `to`_hash (their hashes).

    Each step is a column of its own, which keeps Catalyst from writing it out twice.
    """
    unit, full = f"{to}_unit", f"{to}_full"
    df = df.withColumn(unit, F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({UNIT})"), F.lit(1)), lambda x: F.xxhash64(x)))
    df = df.withColumn(full, F.col(unit))
    for step in range(1, k):
        df = _pairs(df, full, unit, step, lambda a, b: _rotated(a).bitwiseXOR(b))
    few = F.aggregate(unit, F.lit(0).cast("bigint"), lambda a, b: _rotated(a).bitwiseXOR(b))
    df = df.withColumn(full, F.when((F.size(unit) > 0) & (F.size(unit) < k), F.array(few)).otherwise(F.col(full))).drop(unit)
    df = df.withColumn(to, F.transform(full, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 31).bitwiseOR(F.lit(_LOW) - i)))
    least = f"{to}_least"
    df = df.withColumn(least, F.when((F.size(to) > 0) & (F.size(to) < w), F.array(F.array_min(to))))
    size = 1
    while size < w:
        step = min(size, w - size)
        df = _pairs(df, to, to, step, lambda a, b: F.least(a, b))
        size += step
    df = df.withColumn(to, F.transform(F.array_distinct(F.coalesce(least, to)), lambda v: (F.lit(_LOW) - v.bitwiseAND(_LOW)).cast("int"))).drop(least)
    return df.withColumn(f"{to}_hash", F.transform(to, lambda p: F.element_at(full, p + 1))).drop(full)


def shown(positions: str, hashes: str) -> Column:
    """`position:hash` of each selected gram, in order."""
    return F.array_join(F.zip_with(positions, hashes, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.hex(h))), " ")


def likeness(a: str, b: str) -> Column:
    """Shared share of the distinct hashes of two texts; 1 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def dealt(df: DataFrame, order: str, ties: str) -> tuple[DataFrame, list[str]]:
    """(df in ranges of `order` that are buckets of a partition, sorted, with the bounding rows copied; the bucket's columns).

    Quantiles cut the order into buckets. The rows at a bound are dealt to their own bucket and, as sentinels, to the one
    before, so each bucket finds all successors of its rows after one shuffle and no task sees more. The bounds, at most
    GROUPS * GROUPS numbers, reach the rows as the value of a scalar subquery and aren't part of the plan.
    """
    key = F.coalesce(F.col(order), F.lit(-(1 << 63)))
    n = df.count()
    parts = max(1, min(GROUPS * GROUPS, n // BUCKET))
    at, late, rank = f"__{order}_bucket", f"__{order}_late", f"__{order}_rank"
    cuts = F.array(F.min(key))
    if parts > 1:
        shares = F.from_json(F.lit(json.dumps([i / parts for i in range(1, parts)])), "array<double>")
        cuts = F.concat(cuts, F.percentile_approx(key, shares, max(10_000, 4 * parts)))
    bounds = df.agg(F.array_sort(F.array_distinct(cuts)).alias("b"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / GROUPS).cast("int")), lambda g: F.slice("b", g * GROUPS + 1, F.lit(GROUPS)))
    bounds = bounds.select(F.struct(F.size("b").alias("n"), F.transform(groups, lambda g: g[0]).alias("heads"), groups.alias("groups")).alias("b")).scalar()
    df, bounds = df.withColumns({rank: key, f"{at}_bounds": bounds}), F.col(f"{at}_bounds")
    df = df.withColumn(f"{at}_outer", F.size(F.filter(bounds["heads"], lambda b: b <= F.col(rank))))
    group = F.element_at(bounds["groups"], F.col(f"{at}_outer"))
    df = df.withColumn(at, (F.col(f"{at}_outer") - 1) * GROUPS + F.size(F.filter(group, lambda b: b <= F.col(rank))))
    before = F.when(F.col(at) == 1, bounds["n"]).otherwise(F.col(at) - 1)
    own = F.struct(F.col(at).alias("b"), F.lit(0).alias("s"))
    copies = F.when(F.array_contains(group, F.col(rank)), F.array(own, F.struct(before.alias("b"), F.lit(1).alias("s")))).otherwise(F.array(own))
    rows = df.withColumn("__deal", F.explode(copies)).drop(at, f"{at}_outer", f"{at}_bounds").withColumns({at: F.col("__deal.b"), late: F.col("__deal.s")}).drop("__deal")
    return rows.repartition(at).sortWithinPartitions(at, late, rank, ties), [at, late, rank]


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness (see the query's contract).

    Null texts count as empty; a null doc_id sorts first; other columns are ignored. Rows with one doc_id all stay and
    follow each other in the order of their texts; the first of them is the next of the document before. An empty table
    gives an empty result.
    """
    base, (at, late, rank) = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    base = fingerprints(base, "text", "grams", k, w)
    by = Window.partitionBy(at).orderBy(late, rank, "text")
    near = base.select("*", F.lead("text").over(by).alias("next_text"), F.lead("grams_hash").over(by).alias("c")).where(F.col(late) == 0)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    near = near.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "grams", "grams_hash", "c", edited.alias("edited"))
    near = near.withColumn("edited_sha256", F.sha2("edited", 256))
    near = fingerprints(near, "edited", "b", k, w)
    return near.select("doc_id", "n_chars", "edited_sha256", shown("grams", "grams_hash").alias("fingerprint"), shown("b", "b_hash").alias("edited_fingerprint"), likeness("grams_hash", "b_hash").alias("near_edited"), likeness("grams_hash", "c").alias("near_next"))
