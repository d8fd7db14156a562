"""What the operators share: scratch tables in the shared folder, Arrow row streams, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce, wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

_PREFIX: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, deleted when the driver ends.

    Only where the setting is absent and the master is local does a temporary folder of this machine serve.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _PREFIX:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            _PREFIX[app] = "file://" + tempfile.mkdtemp(prefix="strata-")
        root = _PREFIX[app]
    out = f"{root.rstrip('/')}/strata/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's own retention applies
        pass


_SCOPES: list[list[tuple[SparkSession, str]]] = []


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Stores what f returns and deletes the tables that f has stored on its way."""

    @wraps(f)
    def run(*args, **how) -> DataFrame:
        mine: list[tuple[SparkSession, str]] = []
        _SCOPES.append(mine)
        try:
            out = f(*args, **how)
        finally:
            _SCOPES.pop()
        try:
            return stored(out, f.__name__)
        finally:
            for spark, path in mine:
                _delete(spark, path)

    return run


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends, a lost executor costs nothing. The
    shuffle files of the write go with it."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_dir(spark, name)
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def passing(f: Callable) -> Callable:
    """f returns tables from stored(), alone or in a tuple or list; all others that it has stored are deleted."""

    @wraps(f)
    def run(*args, **how):
        mine: list[tuple[SparkSession, str]] = []
        _SCOPES.append(mine)
        try:
            out = f(*args, **how)
        finally:
            _SCOPES.pop()
        kept = {x.__dict__.get("_stored_at") for x in (out if isinstance(out, (tuple, list)) else [out]) if isinstance(x, DataFrame)}
        for spark, path in mine:
            if path not in kept:
                _delete(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append((spark, path))
        return out

    return run


#: Rows, and entries of their arrays, that one task works on or every executor gets: to deal so few out by a key takes a
#: task and a file for each shuffle partition.
FEW = 1 << 15


def rows_of(df: DataFrame, *arrays: str) -> int:
    """The rows of df, a table from stored() or rows of one, and the entries of these arrays; counted once."""
    known = df.__dict__.setdefault("_rows", {})
    if arrays not in known:
        one = sum((F.greatest(F.size(x), F.lit(0)) for x in arrays), F.lit(1))
        known[arrays] = df.agg(F.coalesce(F.sum(one), F.lit(0))).first()[0]
    return known[arrays]


def is_few(df: DataFrame, *arrays: str) -> bool:
    return rows_of(df, *arrays) <= FEW


def gathered(*tables: DataFrame) -> DataFrame:
    """All rows of the tables, in one partition if they are few: what groups or joins them then needs no shuffle."""
    every = reduce(DataFrame.unionAll, tables)
    return every.coalesce(1) if sum(map(rows_of, tables)) <= FEW else every


def beside(df: DataFrame, near: bool) -> DataFrame:
    """df as the right side of a join: at every executor if it is small, else dealt out by its key."""
    return F.broadcast(df) if near else df.hint("merge")


#: The least and the most words of an id filter: 2^15 longs are 2 million bits, 2^20 are 8 MB.
FILTER_WORDS, FILTER_MOST = 1 << 15, 1 << 20


def filter_words(ids: int) -> int:
    """8 bits an id at least, as long as the filter may grow."""
    return min(FILTER_MOST, max(FILTER_WORDS, 1 << (ids // 8).bit_length()))


def marked(df: DataFrame, ids: DataFrame, to: str = "maybe") -> DataFrame:
    """df with a boolean: whether a Bloom filter of the column doc_id of ids may hold the row's doc_id (null: false).

    The filter has one hash and at most FILTER_MOST rows of one long, whatever the number of ids, so it may be
    broadcast. With more ids it lets more strangers through, never fewer members: it only saves a shuffle. ids are
    counted, so they should come from a table.
    """
    h = F.xxhash64("doc_id")
    size = filter_words(ids.count())
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(size)).cast("int"), F.pmod(h, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = ids.where("doc_id is not null").groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    met = df.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    return met.withColumn(to, F.coalesce(F.col("doc_id").isNotNull() & (F.col("__bits").bitwiseAND(one) != 0), F.lit(False))).drop("__word", "__bits")


#: Bytes of one slice of an Arrow batch: what a worker turns into Python objects and arrays at a time.
SLICE = 1 << 20


def slices(batch, columns: Iterable[str], chars: int = SLICE) -> Iterator[list[list]]:
    """Python lists of the columns of one Arrow batch, cut so that one slice holds about `chars` bytes of text."""
    names = list(columns)
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * chars / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        part = batch.slice(at, step)
        yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


#: Bytes of an Arrow batch between the JVM and a worker; both hold one or two at a time for every running task.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of an Arrow batch to BATCH bytes; a lower one stays. One row is never cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH:
        spark.conf.set(name, str(BATCH))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow; at a task's end what it has freed goes back to the machine, so that an idle worker holds little."""

    def every(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)

    return every


def over_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[], Callable[..., dict]], chars: int = SLICE) -> DataFrame:
    """mapInArrow by slices: fn() is called once a task and gives a function from column lists to a dict of arrays. A
    function with an attribute `close` has it called when the task ends."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = fn()
        try:
            for batch in batches:
                for lists in slices(batch, columns, chars):
                    out = work(*lists)
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)
        finally:
            getattr(work, "close", lambda: None)()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(giving_back(run), schema)


def words(text: str | None) -> list[bytes]:
    """The contracts' words, A-Z lower-cased, as UTF-8: bytes.lower knows A-Z alone, bytes.split ASCII white space."""
    return (text or "").encode().lower().split()


def hashes_of(words: list[bytes] | list[str]) -> np.ndarray:
    """64-bit hashes of words. Hashing costs less than looking words up, so nothing is remembered."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; the whole sequence as one if it is shorter; none for no word."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * MULT + h[i : n - k + 1 + i]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w consecutive values."""
    w = min(w, len(x))
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def crc_fold(column) -> F.Column:
    """crc32 of doc_id as text modulo 3: fold 1 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3
