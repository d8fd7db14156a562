"""The engine's operators applied to the driver's tables, each with the SQL that says the same.

The tables hold no source code, so operators meet rows of the same shape: pages are HTML files, parts are symbols,
order lines are call sites, events are file events, embeddings are symbol embeddings.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import text as T
from ..functions import vectors as V
from ..operators import graph, lookup, members, resolve, search, store, worklists
from ..operators.ids import numbered
from ..sources import files as source
from ..streaming import events as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    at = f"{root.rstrip('/')}/strata-steps/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's own retention applies
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a step's result and reads it back."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


# Scalars


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).cast("bigint").alias("n_lines"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS chunk, sha256(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS chunk_hash FROM documents")
def chunk_slice(spark, d):
    c = T.line_slice(F.col("text"), F.lit(2), F.lit(4))
    return table(spark, d, "documents").select("doc_id", c.alias("chunk"), F.sha2(c, 256).alias("chunk_hash"))


@query(r"SELECT doc_id, substr(regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)), '^\s+|\s+$', '', 'g'), 1, 200) AS signature FROM documents")
def signature(spark, d):
    return table(spark, d, "documents").select("doc_id", T.signature(F.col("text"), F.lit(1), F.lit(50)).alias("signature"))


@query("SELECT p_partkey, string_split(p_name, ' ')[-1] AS last_segment, CAST(len(p_name) - len(replace(p_name, ' ', '')) AS BIGINT) AS depth, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN array_to_string(list_slice(string_split(p_name, ' '), 2, 100), '.') ELSE p_name END AS tail FROM part")
def name_segments(spark, d):
    q = F.replace("p_name", F.lit(" "), F.lit("."))
    return table(spark, d, "part").select("p_partkey", T.last_segment(q).alias("last_segment"), T.depth(q).cast("bigint").alias("depth"), T.tail_path(q).alias("tail"))


@query("SELECT page_id, CASE WHEN contains(string_split(url, '/')[-1], '.') THEN CASE lower(string_split(string_split(url, '/')[-1], '.')[-1]) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'ts' THEN 'ts' WHEN 'js' THEN 'js' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' END END AS language FROM pages")
def language_by_extension(spark, d):
    return table(spark, d, "pages").select("page_id", T.language(F.col("url")).alias("language"))


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, '.*://[^/]*/.*[.]html')")
def glob_filter(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").where(source.matches(path, ["*/**/*.html"])).select("page_id", "url")


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short, CASE WHEN lang = '' OR lang IS NULL THEN source ELSE lang END AS embed_text FROM documents")
def truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 60).alias("short"), T.embed_text(F.col("lang"), F.col("source")).alias("embed_text"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squared_norm, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))), 6) AS unit_sum FROM embeddings")
def vector_norm(spark, d):
    n = V.norm(F.col("embedding"))
    unit = V.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n * n, 6).alias("squared_norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query(
    r"""SELECT p_partkey, format('{:.1f}', CAST(p_size AS DOUBLE) / 50 * 100) AS share, CASE p_size % 3 WHEN 0 THEN 'type definition' WHEN 1 THEN 'method' ELSE p_brand END AS kind,
    CAST(CASE p_size % 4 WHEN 0 THEN 384 WHEN 1 THEN 3072 ELSE 1536 END AS INTEGER) AS dimension, CASE WHEN p_size % 2 = 0 THEN 'lib/' || p_brand || '.go' ELSE '/other/' || p_brand || '.go' END AS path,
    'Describe in one or two sentences what this method does.' || chr(10) || 'Name: ' || p_name || chr(10) || 'Code:' || chr(10) || p_type AS prompt FROM part"""
)
def scalar_formats(spark, d):
    part, n = table(spark, d, "part"), F.col("p_size")
    kind = F.when(n % 3 == 0, "type").when(n % 3 == 1, "method").otherwise(F.col("p_brand"))
    model = F.when(n % 4 == 0, "bge-small-en-v1.5").when(n % 4 == 1, "text-embedding-3-large").otherwise("unknown")
    file = F.concat(F.when(n % 2 == 0, "file:///src/lib/").otherwise("/other/"), "p_brand", F.lit(".go"))
    return part.select("p_partkey", T.percent(n.cast("double") / 50).alias("share"), T.kind_text(kind).alias("kind"), T.dimension(model).alias("dimension"), T.relative(file, "/src").alias("path"), T.prompt(F.lit("method"), F.col("p_name"), F.col("p_type")).alias("prompt"))


# Lookups


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part) AND p_brand = (SELECT min(p_brand) FROM part WHERE p_name = (SELECT min(p_name) FROM part))")
def find_symbols(spark, d):
    part = table(spark, d, "part")
    first = part.agg(F.min("p_name").alias("n"), F.min_by("p_brand", F.struct("p_name", "p_brand")).alias("b")).first()
    sym = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("language"))
    return lookup.find_symbols(sym, first.n, first.b).select(F.col("symbol_id").alias("p_partkey"), F.col("name").alias("p_name"), F.col("language").alias("p_brand"))


@query("SELECT symbol_id, path, kind FROM (SELECT p_partkey AS symbol_id, 'src/' || p_brand || '.go' AS path, p_type AS kind FROM part WHERE p_name = (SELECT min(p_name) FROM part)) ORDER BY (contains(path, '2')) DESC, (kind = (SELECT min(p_type) FROM part)) DESC, symbol_id LIMIT 1")
def find_symbol(spark, d):
    part = table(spark, d, "part")
    first = part.agg(F.min("p_name").alias("n"), F.min("p_type").alias("t")).first()
    brands = part.select("p_brand").distinct().select(F.xxhash64("p_brand").alias("file_id"), F.concat(F.lit("src/"), "p_brand", F.lit(".go")).alias("path"))
    sym = part.select(F.col("p_partkey").alias("symbol_id"), F.xxhash64("p_brand").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    best = lookup.find_symbol(sym, brands, first.n, in_file="2", kind=first.t)
    return best.join(brands, "file_id").select("symbol_id", "path", "kind")


@query(
    """SELECT 'by_id' AS lookup, p_partkey AS id FROM part WHERE p_partkey = 7 UNION ALL SELECT 'by_path', c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)
    UNION ALL SELECT 'in_file', o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'calls_from', l_linenumber FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 'calls_to', l_linenumber FROM lineitem WHERE l_partkey = 7
    UNION ALL SELECT 'has_embedding', CAST(count(*) > 0 AS INTEGER) FROM embeddings WHERE vec_id = 5 UNION ALL SELECT 'has_embedding', 0 UNION ALL SELECT 'embedding', len(embedding) FROM embeddings WHERE vec_id = 5"""
)
def point_lookups(spark, d):
    first = table(spark, d, "customer").agg(F.min("c_name")).first()[0]
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller_symbol_id"), F.col("l_partkey").alias("callee_symbol_id"), "l_linenumber")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit("m").alias("model"), "embedding")
    has = spark.createDataFrame([(int(lookup.has_embedding(vectors, 5, m)),) for m in ("m", "other")], "id bigint")
    found = {
        "by_id": lookup.by_id(table(spark, d, "part"), "p_partkey", 7).select(F.col("p_partkey").alias("id")),
        "by_path": lookup.file_by_path(table(spark, d, "customer").withColumnRenamed("c_name", "path"), first).select("c_custkey"),
        "in_file": lookup.in_file(table(spark, d, "orders").withColumnRenamed("o_custkey", "file_id"), 7).select("o_orderkey"),
        "calls_from": lookup.calls_from(calls, 3).select("l_linenumber"),
        "calls_to": lookup.calls_to(calls, 7).select("l_linenumber"),
        "has_embedding": has,
        "embedding": lookup.embedding(vectors, 5, "m").select(F.size("embedding")),
    }
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("lookup"), F.col(df.columns[0]).cast("bigint").alias("id"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT c_custkey, c_name, n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def definition(spark, d):
    sym = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("file_id"), F.col("c_name").alias("name"), F.col("c_name").alias("qualified_name"), *[F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    files = table(spark, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path"))
    # start_line and its like are columns of the symbols; the path comes from the files
    return lookup.definition(sym, files).select(F.col("symbol_id").alias("c_custkey"), F.col("name").alias("c_name"), F.col("location.path").alias("path"))


@query("SELECT l_orderkey, l_linenumber, s_name AS path, l_returnflag AS ref_kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 7")
def references(spark, d):
    zero = [F.lit(0).alias(f"from_{c}") for c in ("start_col", "end_line", "end_col")]
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref_id"), F.col("l_suppkey").alias("from_file_id"), F.col("l_linenumber").alias("from_start_line"), *zero, F.col("l_partkey").alias("to_symbol_id"), F.col("l_returnflag").alias("ref_kind"))
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("path"))
    return lookup.references(refs, files, 7).select(F.col("ref_id").alias("l_orderkey"), F.col("location.start_line").alias("l_linenumber"), F.col("location.path").alias("path"), "ref_kind")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(p_name, 'red ') AND p_type IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3)")
def object_members(spark, d):
    part = table(spark, d, "part")
    kinds = [r.p_type for r in part.select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    sym = part.select(F.col("p_partkey").alias("symbol_id"), F.lit(1).alias("file_id"), F.col("p_name").alias("name"), F.when(F.col("p_type").isin(kinds), "method").otherwise("function").alias("kind"), F.lit("ts").alias("language"), dotted.alias("qualified_name"), "p_type", *[F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    owner = part.limit(1).select(F.lit(-1).cast("bigint").alias("symbol_id"), F.lit(1).alias("file_id"), F.lit("red").alias("name"), F.lit("class").alias("kind"), F.lit("ts").alias("language"), F.lit("red").alias("qualified_name"), F.lit("").alias("p_type"), *[F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    files = spark.range(1, 2).select(F.col("id").cast("int").alias("file_id"), F.lit("a.ts").alias("path"))
    found = members.object_properties(sym.unionByName(owner), files, "red")
    return found.join(part.select(F.col("p_partkey").alias("symbol_id"), "p_type"), "symbol_id").select(F.col("symbol_id").alias("p_partkey"), F.col("name").alias("p_name"), "p_type")


def _members_of(spark, d, name: str, language: str) -> DataFrame:
    """Parts as symbols, the words of their names as segments, and one owner; every other part is a method."""
    zero = [F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")]
    part = table(spark, d, "part")
    sym = part.select(F.col("p_partkey").alias("symbol_id"), F.lit(1).alias("file_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "method").otherwise("field").alias("kind"), F.lit(language).alias("language"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified_name"), *zero)
    owner = spark.range(1).select(F.lit(-1).cast("bigint").alias("symbol_id"), F.lit(1).alias("file_id"), F.lit(name).alias("name"), F.lit("struct").alias("kind"), F.lit(language).alias("language"), F.lit(name).alias("qualified_name"), *zero)
    return members.object_properties(sym.unionByName(owner), spark.range(1, 2).select(F.col("id").cast("int").alias("file_id"), F.lit("a.go").alias("path")), name)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red ') OR p_partkey % 2 = 0 AND contains(p_name, 'red ')")
def union_dedup(spark, d):
    """Members by prefix and, in Go, methods by their receiver anywhere in the name; each once."""
    return _members_of(spark, d, "red", "go").select(F.col("symbol_id").alias("p_partkey"), F.col("name").alias("p_name"))


@query("SELECT p_partkey, CAST(len(p_name) - len(replace(p_name, ' ', '')) AS BIGINT) AS depth, replace(substr(p_name, 5), ' ', '.') AS tail FROM part WHERE starts_with(p_name, 'red ')")
def displayed_members(spark, d):
    found = members.displayed(_members_of(spark, d, "red", "ts"))
    return found.select(F.col("symbol_id").alias("p_partkey"), F.col("depth").cast("bigint").alias("depth"), "tail")


@query("SELECT p_name, row_number() OVER (ORDER BY lower(p_name), p_name) AS place FROM (SELECT DISTINCT p_name FROM part)")
def collated_order(spark, d):
    """Places in the order of a Unicode collation: ranges of it are sorted and numbered, no task sees all."""
    names = table(spark, d, "part").select("p_name").distinct().withColumn("k", F.collate("p_name", "UNICODE"))
    got = numbered(names, "k", scratch(spark, "collated"))
    return got.select("p_name", F.col("__seq").alias("place"))


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def stats(spark, d):
    return lookup.stats({n: table(spark, d, n) for n in ("orders", "customer", "part", "lineitem")})


# Extraction


@query(
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>')) AS tag FROM pages),
    c AS (SELECT page_id, unnest(string_split_regex(trim(regexp_extract(tag, ' class="([^"]*)"', 1)), '\s+')) AS v FROM t)
    SELECT page_id, '.' || v AS name, count(*) AS n FROM c WHERE v <> '' GROUP BY ALL"""
)
def html_classes(spark, d):
    tags = F.regexp_extract_all("html", F.lit("(<[a-zA-Z][a-zA-Z0-9-]*[^>]*>)"), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag"))
    names = rows.select("page_id", F.explode(T.class_names(F.trim(F.regexp_extract("tag", ' class="([^"]*)"', 1)))).alias("v"))
    return names.groupBy("page_id", F.concat(F.lit("."), "v").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _page_files(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"), F.col("page_id").alias("file_id"))


#: Of the tags in these pages styles, scripts and classes are symbols, and none holds another of its kind.
_ELEMENTS = r"""WITH e AS (SELECT page_id, html, unnest(regexp_extract_all(html, '(?s)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<div [^>]*class="[^"]*"[^>]*>.*?</div>')) AS el FROM pages),
p AS (SELECT page_id, html, instr(html, el) AS place, left(html, instr(html, el) - 1) AS before, left(html, instr(html, el) - 1 + len(el)) AS through, regexp_extract(el, '^<([a-z]+)', 1) AS tag, string_split_regex(trim(regexp_extract(el, '^<div[^>]* class="([^"]*)"', 1)), '\\s+') AS classes FROM e),
n AS (SELECT *, unnest(CASE WHEN tag = 'div' THEN list_transform(classes, lambda c: '.' || c) ELSE ['<' || tag || '>'] END) AS name FROM p),
l AS (SELECT *, string_split(before, chr(10)) AS b, string_split(through, chr(10)) AS t, string_split(html, chr(10)) AS h FROM n)
SELECT page_id || '.html' AS path, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place, name) - 1 AS INTEGER) AS ordinal, CASE WHEN tag = 'div' THEN 'variable' ELSE 'module' END AS kind, name, name AS qualified_name,
CAST(len(b) AS INTEGER) AS start_line, CAST(len(b[-1]) AS INTEGER) AS start_col, CAST(len(t) AS INTEGER) AS end_line, CAST(len(t[-1]) AS INTEGER) AS end_col,
substr(regexp_replace(array_to_string(list_slice(h, len(b), least(len(t), len(b) + 2)), chr(10)), '^\\s+|\\s+$', '', 'g'), 1, 200) AS signature, true AS exported FROM l"""


@query(_ELEMENTS)
def html_symbols(spark, d):
    """All symbols of all pages with their places: extraction over whole texts."""
    found = source.extract(_page_files(spark, d)).where("item = 'symbol'")
    return found.select("path", "ordinal", "kind", "name", "qualified_name", "start_line", "start_col", "end_line", "end_col", "signature", "exported")


@query("SELECT page_id || '.html' AS path, CAST(len(regexp_extract_all(html, '<style[ >]')) AS BIGINT) AS styles FROM pages WHERE regexp_matches(html, '<style[ >]')")
def html_style_modules(spark, d):
    found = source.extract(_page_files(spark, d)).where("item = 'symbol' and name = '<style>'")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("styles"))


# Resolution


@query(
    """WITH r AS (SELECT event_id AS id, user_id, event_id AS a, event_id + (event_id % 7) * 150 AS b FROM events),
    m AS (SELECT e.event_id, r.id, row_number() OVER (PARTITION BY e.event_id ORDER BY r.b - r.a, r.id) AS k FROM events e JOIN r ON e.user_id = r.user_id AND e.event_id BETWEEN r.a AND r.b)
    SELECT event_id, id AS range_id FROM m WHERE k = 1"""
)
def containing_symbol(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    ranges = e.select("user_id", F.col("event_id").alias("start_line"), (F.col("event_id") + F.col("event_id") % 7 * 150).alias("end_line"), F.col("event_id").alias("ordinal"))
    sites = e.select("user_id", F.col("event_id").alias("site"), F.col("event_id").alias("line"))
    got = resolve.innermost(sites, ranges, "user_id", "site", "line", "ordinal")
    return got.select(F.col("site").alias("event_id"), F.col("inner_range.ordinal").alias("range_id"))


@query(
    """WITH t AS (SELECT p_name, min(p_partkey) AS target_id FROM part GROUP BY p_name)
    SELECT l_orderkey, l_linenumber, target_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN t USING (p_name) WHERE target_id % 50 <= l_orderkey % 50"""
)
def callee_resolution(spark, d):
    part = table(spark, d, "part")
    symbols = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 50).alias("file_seq"))
    sites = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", F.col("p_name").alias("name")), "p_partkey")
    got = resolve.by_name(sites.withColumn("file_seq", F.col("l_orderkey") % 50), symbols)
    return got.select("l_orderkey", "l_linenumber", "target_id")


@query(
    """WITH t AS (SELECT p_type, min(p_partkey) AS target_id FROM part GROUP BY p_type)
    SELECT p_partkey AS site, target_id FROM part JOIN t USING (p_type) WHERE target_id % 20 <= p_size % 20"""
)
def reference_resolution(spark, d):
    part = table(spark, d, "part")
    symbols = part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 20).alias("file_seq"))
    sites = part.select(F.col("p_partkey").alias("site"), F.col("p_type").alias("name"), (F.col("p_size") % 20).alias("file_seq"))
    return resolve.by_name(sites, symbols).select("site", "target_id")


@query("SELECT CAST(p_size AS BIGINT) AS file_id, p_name AS qualified_name, max(p_partkey) AS symbol_id FROM part GROUP BY ALL")
def last_definition(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("file_id"), F.col("p_name").alias("qualified_name"), F.col("p_partkey").alias("symbol_id"))
    return resolve.last_by_qualified_name(rows).select("file_id", "qualified_name", "symbol_id")


# Graphs


def _calls(spark, d) -> DataFrame:
    """Every order line is a call, from its supplier to its part."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("caller_symbol_id"), F.col("l_partkey").alias("callee_symbol_id"))


_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem)),
r(root, node, depth) AS (SELECT x, x, 0 FROM (VALUES (CAST(1 AS BIGINT)), (2), (3)) v(x) UNION SELECT root, dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 3)
SELECT root, node AS node_id, min(depth) AS depth FROM r GROUP BY ALL"""


def _chain(spark, calls: DataFrame, direction: str, mode: str) -> DataFrame:
    roots = spark.createDataFrame([(1,), (2,), (3,)], "root bigint")
    symbols = calls.select(F.col("caller_symbol_id").alias("symbol_id")).union(calls.select("callee_symbol_id")).union(roots).distinct()
    return graph.call_chain(calls, symbols, roots, kept, direction, 3, mode)


@query(_REACH.format(src="a", dst="b"))
def call_reach(spark, d):
    return _chain(spark, _calls(spark, d), "forward", "bfs").select("root", "node_id", "depth")


@query(_REACH.format(src="b", dst="a"))
def call_reach_backward(spark, d):
    return _chain(spark, _calls(spark, d), "backward", "bfs").select("root", "node_id", "depth")


@query()
def call_chain(spark, d):
    """The order-dependent walk over all calls, which a recursive query can't express."""
    return _chain(spark, _calls(spark, d), "forward", "dfs")


# Search


def _query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first().embedding)


_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round(({_DOT} + 1) / 2, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE ({_DOT} + 1) / 2 >= 0.6 ORDER BY ({_DOT} + 1) / 2 DESC, e.vec_id LIMIT 20")
def semantic_search(spark, d):
    got = search.ranked(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20, 0.6)
    return got.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT e.vec_id, e.label, round(({_DOT} + 1) / 2, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 AND ({_DOT} + 1) / 2 >= 0.5 ORDER BY ({_DOT} + 1) / 2 DESC, e.vec_id LIMIT 10")
def filtered_search(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit("m").alias("model"), "embedding")
    symbols = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit(0).alias("file_id"), F.lit("").alias("name"), F.lit("").alias("qualified_name"), F.col("label").cast("string").alias("kind"), F.lit("").alias("language"), F.lit("").alias("chunk_summary"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    found = search.ranked(search.candidates(vectors, symbols, "m", kind="3"), "symbol_id", "embedding", _query_vector(spark, d), 10, 0.5)
    return found.select(F.col("symbol_id").alias("vec_id"), F.col("kind").cast("int").alias("label"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(({_DOT} + 1) / 2, 9) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5")
def batch_search(spark, d):
    """The stated queries, every vec_id divisible by 20, against all rows."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batch_top_k(e, "vec_id", "embedding", queries, 5).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT e.vec_id AS symbol_id, 'f' || (e.vec_id % 7) || '.ts' AS path, round(({_DOT} + 1) / 2, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE ({_DOT} + 1) / 2 >= 0.55 ORDER BY ({_DOT} + 1) / 2 DESC, e.vec_id LIMIT 10")
def search_locations(spark, d):
    """The best symbols and then, for these alone, their places."""
    e = table(spark, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("symbol_id"), F.lit("m").alias("model"), "embedding")
    symbols = e.select(F.col("vec_id").alias("symbol_id"), (F.col("vec_id") % 7).alias("file_id"), *[F.lit("").alias(c) for c in ("name", "qualified_name", "kind", "language", "chunk_summary")], F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    files = spark.range(7).select(F.col("id").alias("file_id"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    found = search.semantic_search(vectors, symbols, files, _query_vector(spark, d), "m", 10, min_similarity=0.55)
    return found.select("symbol_id", "path", F.round("similarity", 6).alias("similarity"))


# Worklists and changes


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND labels.quality = 1)")
def needs_embedding(spark, d):
    symbols = table(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.lit("1").alias("chunk_hash"), "source")
    have = table(spark, d, "labels").select(F.col("doc_id").alias("symbol_id"), F.lit("m").alias("model"), F.col("quality").cast("string").alias("chunk_hash"))
    return worklists.needs_embedding(symbols, have, "m").select(F.col("symbol_id").alias("doc_id"), "source")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def needs_summary(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("chunk_summary"))
    return worklists.needs_summary(table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")).select("doc_id")


@query("SELECT CAST(count_if(toxic = 0) AS BIGINT) AS succeeded, CAST(count_if(toxic = 1) AS BIGINT) AS failed, CAST(sum(quality) AS BIGINT) AS tokens FROM labels")
def work_report(spark, d):
    return worklists.report(table(spark, d, "labels").select(F.col("quality").alias("tokens"), F.when(F.col("toxic") == 1, "toxic").alias("error")))


@query("SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0) k USING (doc_id) WHERE k.h IS NULL OR k.h <> sha256(d.text)")
def changed_files(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), T.content_hash(F.col("text")).alias("content_hash"))
    known = docs.where("path % 5 != 0").withColumn("content_hash", F.when(F.col("path") % 4 == 0, "old").otherwise(F.col("content_hash")))
    return source.changed(docs, known).select(F.col("path").alias("doc_id"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return store.keep_latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def _index_tables(spark, d) -> dict[str, DataFrame]:
    """Customers as files, orders as symbols, order lines as calls and as references, embeddings of orders."""
    null = lambda t: F.lit(None).cast(t)
    fill = lambda df, kind: store.migrate(df, kind)
    line = table(spark, d, "lineitem")
    orders = table(spark, d, "orders")
    return {
        "files": fill(table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path")), schema.FILES),
        "symbols": fill(orders.select(F.col("o_orderkey").alias("symbol_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderstatus").alias("name")), schema.SYMBOLS),
        "calls": fill(line.select(F.col("l_partkey").alias("call_id"), F.col("l_orderkey").alias("caller_symbol_id"), F.col("l_orderkey").alias("callee_symbol_id"), F.col("l_linenumber").cast("int").alias("site_start_line")), schema.CALLS),
        "symbol_references": fill(line.select(F.col("l_orderkey").alias("ref_id"), F.col("l_suppkey").alias("from_file_id"), F.col("l_orderkey").alias("to_symbol_id"), F.col("l_returnflag").alias("ref_kind")), schema.REFERENCES),
        "symbol_embeddings": fill(orders.select(F.col("o_orderkey").alias("symbol_id"), F.lit("m").alias("model"), null("array<float>").alias("embedding")), schema.EMBEDDINGS),
    }


_GONE = "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 = 0"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN ({_GONE})")
def cascade_delete(spark, d):
    tables = _index_tables(spark, d)
    left = store.delete_by_file(tables, tables["files"].where("file_id % 5 = 0"))["calls"]
    return left.select(F.col("caller_symbol_id").alias("l_orderkey"), F.col("site_start_line").cast("bigint").alias("l_linenumber"), F.col("call_id").alias("l_partkey"))


@query(f"SELECT 'files' AS name, (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0) AS rows UNION ALL SELECT 'symbols', (SELECT count(*) FROM orders WHERE o_custkey % 5 <> 0) UNION ALL SELECT 'calls', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN ({_GONE})) UNION ALL SELECT 'symbol_references', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN ({_GONE}) AND l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)) UNION ALL SELECT 'symbol_embeddings', (SELECT count(*) FROM orders WHERE o_custkey % 5 <> 0)")
def delete_by_file(spark, d):
    tables = _index_tables(spark, d)
    return lookup.stats(store.delete_by_file(tables, tables["files"].where("file_id % 5 = 0")))


@query("SELECT coalesce(c_custkey, path_id) AS path_id, coalesce(priority, c_mktsegment) AS status FROM customer FULL JOIN (SELECT 2 * o_orderkey AS path_id, max(o_orderpriority) AS priority FROM orders GROUP BY 1) o ON c_custkey = path_id")
def insert_or_update(spark, d):
    """All customers as known files, all orders as files at every other path: some are known, some new, some both."""
    row = lambda df, path, value: df.groupBy(path.cast("string").alias("path")).agg(F.max(value).alias("content_hash")).select("path", F.lit("ts").alias("language"), "content_hash", F.lit(0.0).alias("mtime"), F.lit(0).cast("bigint").alias("size"))
    old = row(table(spark, d, "customer"), F.col("c_custkey"), "c_mktsegment").withColumns({"file_id": F.col("path").cast("bigint"), "indexed_at": F.lit(0).cast("bigint")})
    got = store.upsert_files(old, row(table(spark, d, "orders"), 2 * F.col("o_orderkey"), "o_orderpriority"), 1, scratch(spark, "upsert"))
    return got.select(F.col("path").cast("bigint").alias("path_id"), F.col("content_hash").alias("status"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'toxic ' || l.toxic END AS chunk_summary, CAST(coalesce(l.quality, -1) AS INTEGER) AS summary_tokens, CAST(CASE WHEN l.doc_id IS NULL THEN 4 ELSE 9 END AS BIGINT) AS summarized_at FROM documents d LEFT JOIN labels l USING (doc_id)")
def summary_update(spark, d):
    symbols = table(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.lit(None).cast("string").alias("chunk_hash"), F.col("source").alias("chunk_summary"), F.lit(-1).alias("summary_tokens"), F.lit(4).cast("bigint").alias("summarized_at"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("symbol_id"), F.lit("h").alias("chunk_hash"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("summary"), F.col("quality").alias("tokens"))
    return store.update_summaries(symbols, new, 9).select(F.col("symbol_id").alias("doc_id"), "chunk_summary", "summary_tokens", "summarized_at")


@query("WITH t AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host FROM pages) SELECT page_id, path FROM t WHERE NOT (path = (SELECT min(host) FROM t) OR starts_with(path, (SELECT min(host) FROM t) || '/'))")
def directory_delete(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    host = p.agg(F.min(F.element_at(F.split("path", "/"), 1)).alias("h")).first().h
    return p if host is None else p.where(~store.below(F.col("path"), host))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_id) AS seq, CAST(sum(user_id) OVER (ORDER BY event_id) - user_id AS BIGINT) AS base FROM events")
def dense_numbers(spark, d):
    got = numbered(table(spark, d, "events").select("event_id", "user_id"), "event_id", scratch(spark, "ids"), "user_id")
    return got.select("event_id", F.col("__seq").alias("seq"), F.col("__base").alias("base"))


# Events


@query("SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 HOUR")
def debounce(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.debounced(e, "user_id", "ts", "1 hour", "event_id").select("event_id", "user_id")


@query("SELECT conv_id, turn FROM (SELECT *, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM conversations) WHERE delta IS NULL OR abs(delta) >= 50")
def line_delta(spark, d):
    return stream.changed_enough(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 50).select("conv_id", "turn")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type AS path FROM events),
    w(key, s) AS (SELECT key, min(sec) FROM e GROUP BY key UNION ALL SELECT w.key, min(e.sec) FROM w JOIN e ON e.key = w.key AND e.sec >= w.s + 86400 GROUP BY w.key)
    SELECT w.key, w.s AS window_start, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM w JOIN e ON e.key = w.key AND e.sec >= w.s AND e.sec < w.s + 86400 GROUP BY ALL"""
)
def batch_windows(spark, d):
    """Windows opened by their first event: each depends on the one before."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("bigint").alias("at"), "event_type")
    return stream.batch_windows(e, "user_id", "at", "event_type", 86_400).select("key", "window_start", F.array_join("paths", ",").alias("paths"))
