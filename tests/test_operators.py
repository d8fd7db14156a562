import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codestrata import config
from codestrata.operators import graph, resolve, store
from codestrata.plans import catalog
from codestrata.sources.files import glob_regex


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_query_equals_its_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    sql = catalog.ORACLE_SQL.get(name)
    if not sql:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "lineitem", "events", "embeddings", "labels", "orders", "customer", "nation", "supplier", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "path"


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("**/*.go", ["a.go", "x/y/a.go"], ["a.gox", "ago"]),
        ("src/**/*", ["src/a", "src/b/c"], ["src2/a", "src"]),
        ("*.{ts,tsx}", ["a.ts", "a.tsx"], ["x/a.ts", "a.t"]),
        ("**/node_modules/**", ["node_modules/x", "a/node_modules/b/c"], ["node_modules2/x"]),
        ("a?[bc].x", ["a1b.x"], ["a1d.x", "a/b.x"]),
    ],
)
def test_globs(pattern, yes, no):
    import re

    for p in yes:
        assert re.match(glob_regex(pattern), p), p
    for p in no:
        assert not re.match(glob_regex(pattern), p), p


def walk(adjacency, root, depth):
    """The recursive definition."""
    out, seen = [], set()

    def go(node, parent, level):
        if level > depth or node in seen:
            return
        seen.add(node)
        out.append((node, parent, level))
        for x in adjacency.get(node, []):
            go(x, node, level + 1)

    go(root, None, 0)
    return out


def test_depth_first_walk_is_not_breadth_first(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 4)]
    calls = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "call_id bigint, caller_symbol_id bigint, callee_symbol_id bigint")
    symbols = spark.createDataFrame([(i,) for i in range(1, 5)], "symbol_id bigint")
    roots = spark.createDataFrame([(1,), (9,)], "root bigint")
    keep = lambda df, n: df.persist()
    rows = graph.call_chain(calls, symbols, roots, keep, "forward", 2).collect()
    assert [(r.node_id, r.depth) for r in sorted(rows, key=lambda r: r.preorder)] == [(1, 0), (2, 1), (3, 2)]
    near = graph.call_chain(calls, symbols, roots, keep, "forward", 2, "bfs").collect()
    assert {r.node_id for r in near} == {1, 2, 3, 4}
    back = graph.call_chain(calls, symbols, spark.createDataFrame([(4,)], "root bigint"), keep, "backward", 5).collect()
    assert {r.node_id for r in back} == {1, 2, 3, 4}


def test_iterative_walk_equals_recursive():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9)
        adjacency = {a: [r.randrange(n) for _ in range(r.randint(0, 4))] for a in range(n)}
        depth = r.randint(0, 5)
        got = graph.depth_first(adjacency, 0, depth)
        assert [(x[1], x[2], x[3]) for x in got] == walk(adjacency, 0, depth)


def test_innermost_range_takes_the_first_of_equals(spark):
    ranges = spark.createDataFrame([(1, 1, 10, 0), (1, 3, 6, 1), (1, 3, 6, 2)], "file_id int, start_line int, end_line int, ordinal int")
    sites = spark.createDataFrame([(1, 7, 4), (1, 8, 9), (1, 9, 99)], "file_id int, site int, line int")
    got = {r.site: r.inner_range.ordinal for r in resolve.innermost(sites, ranges, "file_id", "site", "line", "ordinal").collect()}
    assert got == {7: 1, 8: 0}


def test_resolution_equals_sequential_indexing(spark):
    r = random.Random(2)
    symbols, sites, names = [], [], "abcde"
    for f in range(12):
        symbols += [(r.choice(names), len(symbols) + k, f) for k in range(r.randint(0, 3))]
        sites += [(len(sites) + k, r.choice(names), f) for k in range(r.randint(0, 3))]
    want = {}
    for i, name, f in sites:
        known = [s for n, s, g in symbols if n == name and g <= f]
        if known:
            want[i] = min(known)
    s = spark.createDataFrame(symbols, "name string, symbol_id bigint, file_seq bigint")
    c = spark.createDataFrame(sites, "site bigint, name string, file_seq bigint")
    assert {x.site: x.target_id for x in resolve.by_name(c, s).collect()} == want


def test_embedding_upsert_keeps_the_first_creation(spark):
    kind = "symbol_id bigint, model string, dim int, embedding array<float>, chunk_hash string, created_at bigint, updated_at bigint"
    old = spark.createDataFrame([(1, "m", 1, [1.0], "a", 10, 10), (2, "m", 1, [2.0], "b", 10, 10)], kind)
    new = spark.createDataFrame([(1, "m", 1, [3.0], "c", 20, 20)], kind)
    got = {r.symbol_id: (r.chunk_hash, r.created_at, r.updated_at) for r in store.upsert_embeddings(old, new).collect()}
    assert got == {1: ("c", 10, 20), 2: ("b", 10, 10)}


def test_summary_updates_keep_zero_tokens_and_empty_text(spark):
    s = spark.createDataFrame([(1, None, None, None, None), (2, "h", "s", 3, 4)], "symbol_id bigint, chunk_hash string, chunk_summary string, summary_tokens int, summarized_at bigint")
    u = spark.createDataFrame([(1, "n", "", 0)], "symbol_id bigint, chunk_hash string, summary string, tokens int")
    got = {r.symbol_id: tuple(r)[1:] for r in store.update_summaries(s, u, 9).collect()}
    assert got == {1: ("n", "", 0, 9), 2: ("h", "s", 3, 4)}


def test_config_layers(tmp_path):
    path = config.write_default(tmp_path)
    with pytest.raises(FileExistsError):
        config.write_default(tmp_path)
    assert path.exists()
    c = config.load(tmp_path, {"maxNestedStructDepth": 0, "languages": None}, {"STRATA_EMBEDDING_MODEL": "m", "STRATA_EMBEDDING_DIMENSION": "8"})
    assert c["maxNestedStructDepth"] == 0 and c["languages"] == ["ts", "js"]
    assert c["embedding"]["model"] == "m" and c["embedding"]["dimension"] == 8


def test_blob_codec_and_response_shapes(spark):
    from codestrata.functions import text, vectors

    df = spark.createDataFrame([(bytearray(vectors.encode_blob([1.5, -2.0])), '{"data":[{"embedding":[1,2]}]}'), (None, '{"embeddings":[[3,4]]}'), (None, '{"embedding":[5]}')], "b binary, j string")
    rows = df.select(vectors.decode_blob(F.col("b")).alias("v"), text.response_vector(F.col("j")).alias("r")).collect()
    assert rows[0].v == [1.5, -2.0] and rows[1].v is None
    assert [r.r for r in rows] == [[1.0, 2.0], [3.0, 4.0], [5.0]]


def test_vectors_of_length_zero_and_other_dimensions(spark):
    from codestrata.functions import vectors
    from codestrata.operators import search

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0])], "id bigint, v array<double>")
    assert [r.u for r in df.orderBy("id").select(vectors.normalize(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8], [1.0]]
    assert [(r.id, r.similarity) for r in search.ranked(df, "id", "v", [1.0, 0.0], 5, 0.0).collect()] == [(2, 2.0), (1, 0.5)]


def test_call_chain_walks_all_order_lines(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").collect()
    adjacency = {}
    for r in sorted(line, key=lambda r: (r.l_orderkey * 10 + r.l_linenumber, r.l_partkey)):  # some calls share an id
        adjacency.setdefault(r.l_suppkey, dict()).setdefault(r.l_partkey)
    want = [x for root in (1, 2, 3) for x in graph.depth_first({k: list(v) for k, v in adjacency.items()}, root, 3)]
    got = [tuple(r) for r in catalog.call_chain(spark, sf).collect()]
    assert sorted(got) == sorted(want) and max(r[1] for r in want) > 100


@pytest.mark.parametrize("walk", [0, 60])
def test_call_chains_beyond_one_task_equal_the_walk(spark, monkeypatch, walk):
    monkeypatch.setattr(graph, "WALK", walk)  # 60: the callers' own calls fit in one task, all calls don't
    r = random.Random(8)
    edges = [(r.randrange(12), r.choice([r.randrange(12), 20 + r.randrange(60), 20 + r.randrange(60)])) for _ in range(160)]
    calls = spark.createDataFrame([(i // 2, a, b) for i, (a, b) in enumerate(edges)], "call_id bigint, caller_symbol_id bigint, callee_symbol_id bigint")
    symbols = spark.range(0, 78).select(F.col("id").alias("symbol_id"))  # 78 and 79 are no symbols
    adjacency = {}
    for _, a, b in sorted((i // 2, a, b) for i, (a, b) in enumerate(edges)):
        if b < 78:
            adjacency.setdefault(a, {}).setdefault(b)
    adjacency = {k: list(v) for k, v in adjacency.items()}
    roots = spark.createDataFrame([(0,), (1,), (50,)], "root bigint")
    want = [x for root in (0, 1, 50) for x in graph.depth_first(adjacency, root, 3)]
    got = [tuple(x) for x in graph.call_chain(calls, symbols, roots, lambda df, n: df.persist(), "forward", 3).collect()]
    assert sorted(got) == sorted(want) and max(x[3] for x in want) == 3


def test_batch_search_equals_brute_force_over_cells(spark, monkeypatch):
    from codestrata.operators import search

    monkeypatch.setattr(search, "CELL", 4)
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(90)] + [(200 + i, [1.0, float(i)]) for i in range(6)] + [(300, None), (301, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    queries = [(i, v) for i, v in rows if i % 20 == 0 or i >= 200]
    got = search.batch_top_k(df, "id", "v", spark.createDataFrame(queries, "query_id bigint, vector array<double>"), 4, 0.0, spread=3).collect()
    want = set()
    for q, v in queries:
        if v:
            s = sorted((-(sum(a * b for a, b in zip(v, x)) + 1) / 2, i) for i, x in rows if x is not None and len(x) == len(v))
            want |= {(q, i, k + 1) for k, (x, i) in enumerate([y for y in s if y[0] <= 0][:4])}
    assert {(x.query_id, x.id, x.rank) for x in got if x.query_id != 301} == want


def test_innermost_range_over_many_bins(spark):
    r = random.Random(6)
    ranges = [(f, a, a + r.choice([0, 3, 70, 700, 5000]), k) for k, (f, a) in enumerate((r.randrange(3), r.randrange(4000)) for _ in range(300))]
    sites = [(r.randrange(3), k, r.randrange(-5, 6000)) for k in range(400)]
    got = {x.site: x.inner_range.ordinal for x in resolve.innermost(spark.createDataFrame(sites, "file_id int, site int, line int"), spark.createDataFrame(ranges, "file_id int, start_line int, end_line int, ordinal int"), "file_id", "site", "line", "ordinal").collect()}
    want = {}
    for f, k, line in sites:
        held = [(b - a, o) for g, a, b, o in ranges if g == f and a <= line <= b]
        if held:
            want[k] = min(held)[1]
    assert got == want
