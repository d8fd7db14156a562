"""Semantic search: filtered exact cosine top-k over symbol embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def candidates(embeddings: DataFrame, symbols: DataFrame, model: str, language: str | None = None, kind: str | None = None) -> DataFrame:
    """Embeddings of a model with their symbols, restricted before the join."""
    chosen = symbols
    if language is not None:
        chosen = chosen.where(F.col("language") == language)
    if kind is not None:
        chosen = chosen.where(F.col("kind") == kind)
    keep = chosen.select("symbol_id", "file_id", "name", "qualified_name", "kind", "language", "chunk_summary", "start_line", "end_line")
    return embeddings.where(F.col("model") == model).select("symbol_id", "embedding").join(keep, "symbol_id")


def ranked(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int = 10, least: float = 0.7) -> DataFrame:
    """The top_k rows by (dot + 1) / 2 that reach `least`, ties by key. Vectors of another dimension are left out.

    The query is a literal array, so there is no join, and the order ends in TakeOrderedAndProject: each task keeps
    top_k rows.
    """
    same = vectors.where(F.size(vector) == len(query))
    scored = same.withColumn("similarity", V.similarity(V.dot_constant(F.col(vector), query)))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(top_k)


def semantic_search(embeddings: DataFrame, symbols: DataFrame, files: DataFrame, query: list[float], model: str, top_k: int = 10, language: str | None = None, kind: str | None = None, min_similarity: float = 0.7) -> DataFrame:
    """The symbols nearest to a query vector with their places. An explicit 0 of top_k or min_similarity holds."""
    best = ranked(candidates(embeddings, symbols, model, language, kind), "symbol_id", "embedding", query, top_k, min_similarity)
    return best.drop("embedding").join(files.select("file_id", "path"), "file_id").orderBy(F.desc("similarity"), "symbol_id")


#: Query vectors of one cell, and decimals by which similarities are ranked, so that equal vectors are equal.
CELL, DECIMALS = 4096, 9


def batch_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, top_k: int, least: float = 0.0, spread: int | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): for each query vector its top_k rows by (dot + 1) / 2, ties by key.

    queries: query_id, vector. All queries meet all rows in a grid of cells: queries are dealt to as many rows of cells
    as keep CELL of them each, vectors to `spread` columns (by default what makes a cell for each of the session's
    shuffle partitions). In a cell the queries come first and vectors stream by in blocks; it keeps top_k rows a query,
    so what goes on to the final ranking is top_k rows a query and column. Vectors of other dimensions don't meet; null
    vectors meet nothing.
    """
    import numpy as np
    from pyspark.sql.window import Window

    spark = vectors.sparkSession
    size = queries.count()
    high = max(1, -(-size // CELL))
    wide = spread or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // high)
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    ask = queries.where(F.col("vector").isNotNull()).select(F.pmod(F.xxhash64("query_id"), F.lit(high)).cast("int").alias("r"), F.explode(numbers(wide)).alias("c"), F.lit(0).alias("kind"), F.col("query_id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(wide)).cast("int").alias("c"), F.lit(1).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("r", F.explode(numbers(high))).select("r", "c", "kind", "id", "v")
    dealt = ask.unionAll(rows).repartition("r", "c").sortWithinPartitions("r", "c", "kind")

    def run(batches):
        import pandas as pd

        cell, asked, best = None, {}, {}

        def told():
            for dim, (ids, _) in asked.items():
                k, s = best[dim]
                q, at = np.nonzero(s >= least)
                if len(q):
                    yield pd.DataFrame({"query_id": ids[q], key: k[q, at], "similarity": s[q, at]})

        def ready():
            for dim, (ids, v) in list(asked.items()):
                if isinstance(ids, list):
                    asked[dim] = np.array(ids, np.int64), np.array(v)
                    best[dim] = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))

        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                for (r, c, kind), group in part.groupby(["r", "c", "kind"], sort=False):
                    if (r, c) != cell:
                        ready()
                        yield from told()
                        cell, asked, best = (r, c), {}, {}
                    for dim, rows in group.groupby(group["v"].map(len), sort=False):
                        if kind == 0:
                            held = asked.setdefault(dim, ([], []))
                            held[0].extend(rows["id"].tolist())
                            held[1].extend(rows["v"].tolist())
                        elif dim in asked:
                            ready()
                            ids, v = asked[dim]
                            s = np.round((v @ np.array(rows["v"].tolist()).T + 1) / 2, DECIMALS)
                            k = np.hstack([best[dim][0], np.broadcast_to(rows["id"].to_numpy(), s.shape)])
                            s = np.hstack([best[dim][1], s])
                            order = np.lexsort((k, -s), axis=1)[:, :top_k]
                            best[dim] = np.take_along_axis(k, order, 1), np.take_along_axis(s, order, 1)
        ready()
        yield from told()

    found = dealt.mapInPandas(run, f"query_id bigint, {key} bigint, similarity double")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
