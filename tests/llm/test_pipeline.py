"""The pipeline, stage by stage."""

import collections
import random
from hashlib import md5, sha256

import numpy as np

import __spark_entry__
import corpus_pipeline as c
from codestrata.llm import bpe, mixture, queries
from codestrata.llm.common import words
from test_operators_llm import P, linked, shingle_sets
from test_substring import left_over


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def fixture(r):
    """Clean texts, copies, near copies, passages that repeat, texts without a letter, nulls and very long texts."""
    fresh = lambda n: [f"{r.choice('abcdefgh')}{r.choice(['ka', 'to', 'mi'])}{r.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(70), []
    for i in range(24):
        texts.append(" ".join(fresh(r.randint(3, 150))))
    texts += [texts[3], texts[5].upper(), " ".join(["edit", *texts[7].split()])]
    texts += [" ".join([*fresh(40), *passage, *fresh(30)]) for _ in range(4)] + [" ".join([*fresh(5), *passage[:35], "changed", *passage[36:], *fresh(9)])]
    texts += [None, "", "12 - 9", " \n", "word " * 20_000, texts[0]]
    return [(i, t, ["en", "de", None][i % 3], f"src{i % 23}" if i % 7 else None, None if t is None else len(t), "kept", 1) for i, t in enumerate(texts)]


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, domain string, copies int"


def test_stages_equal_brute_force_on_their_own_input(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = fixture(random.Random(40))
    docs = spark.createDataFrame(rows, KIND)
    stages = dict(c.STAGES)
    plain = lambda df: {r.doc_id: r for r in df.collect()}

    out = plain(stages["language"](spark, docs, ""))
    assert set(map(tuple, out.values())) == {r for r in rows if r[1] and any(x.isalpha() for x in r[1])}

    docs = spark.createDataFrame(list(out.values()), KIND)
    kept = plain(stages["near_duplicates"](spark, docs, ""))
    group = linked(shingle_sets({i: r.text for i, r in out.items()}), 80)
    assert kept == {i: r for i, r in out.items() if group[i] == i} and len(kept) < len(out)

    docs = spark.createDataFrame(list(kept.values()), KIND)
    cut = plain(stages["substrings"](spark, docs, ""))
    texts = {i: r.text for i, r in kept.items()}
    repeated, _, _ = left_over(texts, [])
    touched = {i for i in texts if i not in cut or cut[i].text != texts[i]}
    assert touched == {i for i, _ in repeated} and len(touched) == 4
    assert left_over({i: r.text for i, r in cut.items()}, [])[0] == set()  # nothing repeats any more
    assert {w for t in texts.values() for w in words(t)} <= {w for r in cut.values() for w in words(r.text)} | {b"changed"}
    assert all(r.n_chars == len(r.text) and r[2:4] == kept[i][2:4] and r[5:] == ("kept", 1) for i, r in cut.items())

    docs = spark.createDataFrame(list(cut.values()), KIND)
    mixed = collections.Counter(r.doc_id for r in stages["mixing"](spark, docs, "").collect())
    home = {f"src{i}": name for name, numbers in mixture.DOMAINS.items() for i in numbers}
    leaves = collections.defaultdict(list)
    for i, r in cut.items():
        leaves[(home.get(r.source, "other"), r.lang or "(none)", r.source or "(none)")].append((i, len(words(r.text))))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    want: dict = {}
    for k, b in mixture.budgets(supply, int(0.8 * sum(supply.values())), mixture.WEIGHTS, 2).items():
        full, rest = divmod(b, supply[k])
        total = 0
        for i, n in sorted(leaves[k], key=lambda x: md5(f"7:{full}:{x[0]}".encode()).hexdigest()):
            total += n
            want[i] = full + (total <= rest)
    assert mixed == collections.Counter({i: n for i, n in want.items() if n})

    t = Tokenizer.from_file(P.path(bpe.TOKENIZER))
    for r in stages["encoding"](spark, docs, "").collect():
        ids = t.encode(cut[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert np.isfinite(len(cut))


def test_stages_keep_columns_and_work_on_the_one_before(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.count() <= count
        count = docs.count()
        assert count > 0
    out = c.STAGES[-1][1](spark, docs, sf)
    assert out.count() == count


def test_stages_take_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_substrings_cut_passages_whose_grams_come_first_in_unlike_documents(spark):
    r = random.Random(41)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = fresh(80)
    rows = [(d, " ".join([*fresh(60), *passage[10 * d : 10 * d + 20], *fresh(60)])) for d in range(7)]
    rows += [(d, " ".join([*fresh(30), *passage, *fresh(30)])) for d in (7, 8)]
    out = {x.doc_id: x.text for x in c.substrings(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert {d for d, t in rows if out.get(d) != t} == {8} and not set(passage) & set(out[8].split())


def test_stored_tables_leave_no_shuffle_files_and_passing_ones_go(spark):
    import os
    import time

    from pyspark.sql import functions as F

    from codestrata.llm.common import passing, stored

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (every.apply(i).getName() for i in range(every.size())) if x.startswith("shuffle_")}

    @passing
    def last(df):
        first = stored(df.groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n")), "a")
        return [stored(first.groupBy("n").agg(F.max("k").alias("k")), "b")], first.inputFiles()

    before = files()
    (out,), gone = passing(lambda df: [stored(df.groupBy("id").count(), "c")])(spark.range(100)), None
    _, gone = last(spark.range(700))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 100 and gone and not any(os.path.exists(x.removeprefix("file://")) for x in gone)
