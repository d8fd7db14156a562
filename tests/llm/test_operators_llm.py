"""The operators against brute force, round trips and hard rows."""

import collections
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import bpe, embed_dup, langid, licenses, mixture, near_dup, quality, substring_dup, token_store, winnow
from codestrata.llm.components import components
from codestrata.llm.tokenize import ByteBpe, WordBpe

P = pytest.importorskip("public_tokenizers")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig binary, component string, parts string, maybe int"


def frame(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), f"src{i % 20}", None if t is None else len(t), None, "c", "p", 1) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, KIND)


def prose(r, n, vocabulary=800):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


HARD = [None, "", "   \n\t", "word", "a b c d", "a b c d e", "ÉCOLE école", "x" * 5000, "<|endoftext|> a <|startoftext|>", "中文字 🙂́ İ", "a\x00b\x1cc\x85d e", "it's we'RE 12½ ª"]


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def linked(sets, percent):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_texts(seed=5, crowd=120):
    r = random.Random(seed)
    base = prose(r, 90).split()
    texts = {i: t for i, t in enumerate(HARD)}
    for i in range(100, 100 + crowd):  # one crowd of near copies, more or less edited
        w = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        texts[i] = " ".join(w)
    for i in range(500, 530):
        texts[i] = prose(r, r.randint(1, 60))
    texts[540], texts[541] = "Same Words  here now ok", "same words here\nnow ok"
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = near_texts()
    sets = shingle_sets(texts)
    want = linked(sets, percent)
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(spark, texts), percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    texts = near_texts(6, 90)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), 85).collect()}
    assert got == linked(shingle_sets(texts), 85)


def test_near_duplicates_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("4", "3", False), ("None", "None", True), ("None", "None", True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    assert near_dup.keep_one(df).count() == 4


def test_bands_and_floors():
    for percent in (80, 85):
        n, r = near_dup.bands(percent, 128, 1e-6)
        assert (1 - (percent / 100) ** r) ** n <= 1e-6 and n * r <= 128
        floors = near_dup.floors(percent, 128, 1e-6)
        assert floors[-1][0] == 128 and 60 < floors[-1][1] < percent * 1.28


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def fuzz(n, seed):
    r = random.Random(seed)
    parts = ["a", "B", "é", "É", "'", "'s", "'RE", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "1", "23", "½", "²", "ª", "!", "..", "<|endoftext|>", "<|", "中", "🙂", "́", "İ", "ß", "Σ", "µ", "_", "-", "the", "ſ", "K", "\x00"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_encoders_equal_the_library():
    from tokenizers import Tokenizer

    texts = [t or "" for t in HARD] + fuzz(3000, 1)
    word, byte = (Tokenizer.from_file(P.path(n)) for n in (token_store.TOKENIZER, bpe.TOKENIZER))
    w, b = WordBpe(P.path(token_store.TOKENIZER)), ByteBpe(P.path(bpe.TOKENIZER))
    w.most = b.most = 10_000  # so that both generations are used
    for t in texts:
        assert np.frombuffer(w.encode(t), "<u4").tolist() == word.encode(t, add_special_tokens=False).ids
        ids = byte.encode(t, add_special_tokens=False).ids
        assert b.encode(t).tolist() == ids
        assert b.decode(ids) == byte.decode(ids, skip_special_tokens=False)


def test_forced_cuts_lie_in_no_token():
    b = ByteBpe(P.path(bpe.TOKENIZER))
    assert any(len(b.cuts(t)) > 1 for t in ("Ġqxzkjv", "zzqqxx"))
    assert all(len(b.cuts(t)) == 1 for t in b.tok.get_vocab(with_added_tokens=False))


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(bpe.TOKENIZER))
    docs = frame(spark, HARD)
    ids = {r.doc_id: t.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids for r in docs.collect()}
    for r in bpe.digest(docs).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest())
    for r in bpe.encode(docs).collect():
        assert r.ids == ids[r.doc_id] and r.text == (HARD[r.doc_id] or "")
    assert bpe.digest(docs.limit(0)).count() == 0


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_store.TOKENIZER))
    docs = frame(spark, HARD + ["the same text"] * 50).repartition(3)
    got = {r.doc_id: r for r in token_store.round_trip(docs).collect()}
    at = 0
    for i, text in enumerate(HARD + ["the same text"] * 50):
        raw = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert token_store.round_trip(docs.limit(0)).count() == 0


def test_token_store_null_and_repeated_ids_and_a_very_long_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_store.TOKENIZER))
    long = "word and more, " * 200_000
    rows = [(None, "b"), (None, None), (-1, "x y"), (-5, "z"), (3, "same"), (3, "same"), (3, "other text"), (9, long)]
    docs = spark.createDataFrame([(d, x, "s") for d, x in rows], "doc_id bigint, text string, shard string")
    got = sorted(token_store.round_trip(docs).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, x) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        raw = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    assert len(got) == len(rows)


def test_a_shard_is_in_the_seekable_format(tmp_path):
    """As its specification says, read without this library's reader."""
    import struct

    import xxhash
    import zstandard

    path = tmp_path / "x.ids"
    docs = {i: np.arange(i % 40, dtype="<u4").tobytes() for i in range(200)}
    with path.open("wb") as f:
        w = token_store.ShardWriter(f, frame_bytes=256)
        w.add(None, b"\1\0\0\0")
        for i, ids in docs.items():
            w.add(i, ids)
        w.close()
    raw = path.read_bytes()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and flags == 0x80
    table = raw[-9 - 12 * n : -9]
    assert struct.unpack("<II", raw[-17 - 12 * n : -9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    at, content = 0, b""
    for size, length, check in struct.iter_unpack("<III", table):
        part = zstandard.ZstdDecompressor().decompress(raw[at : at + size]) if length else b""
        assert len(part) == length and check == xxhash.xxh64_intdigest(part) & 0xFFFFFFFF
        at, content = at + size, content + part
    assert at == len(raw) - 17 - 12 * n and content == b"\1\0\0\0" + b"".join(docs.values())
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == content  # skippable frames are skipped
    with path.open("rb") as f:
        assert [x.tolist() for x in token_store.ShardReader(f).get(None)] == [[1]]


def test_shard_reads_one_frame_and_finds_damage(tmp_path):
    path = tmp_path / "x.ids"
    with path.open("wb") as f:
        w = token_store.ShardWriter(f, frame_bytes=64)
        for i in range(30):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    with path.open("rb") as f:
        r = token_store.ShardReader(f)
        assert len(r.frames) > 6 and r.get(0)[0].size == 0 and r.get(99) == []
        seen = []
        frame_of = r.frame
        r.frame = lambda k: seen.append(k) or frame_of(k)
        assert r.get(17)[0].tolist() == list(range(17)) and len(seen) == 1
        assert [d for d, _ in r.documents()] == list(range(30))
    raw = bytearray(path.read_bytes())
    raw[10] ^= 255
    path.write_bytes(raw)
    with path.open("rb") as f, pytest.raises(Exception):
        list(token_store.ShardReader(f).documents())


def units_of(t):
    """Words; code points of unspaced scripts; of runs over RUN code points those with RUN others of the run on a side."""
    out = []
    low = t or ""
    for word in re.split(r"[\x20\x09-\x0D]+", low):
        for run in re.findall(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]|[^\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]+", word):
            n, i = len(run), 0
            while i < n:
                one = n - i > winnow.RUN or i >= winnow.RUN
                out.append(run[i] if one else run[i:])
                i += 1 if one else n - i
    return out


def fingerprint(lower, hash_of, k=winnow.K, w=winnow.W):
    """[(position, hash)] by the definition: the hash is rolled from gram to gram."""
    mask = (1 << 64) - 1
    rot = lambda h, n: (h << n % 64 | h >> 64 - n % 64) & mask if n % 64 else h
    u = [hash_of[x] & mask for x in units_of(lower)]
    if not u:
        return []
    size = min(k, len(u))
    h = 0
    for x in u[:size]:
        h = rot(h, 1) ^ x
    grams = [h]
    for i in range(len(u) - size):
        h = rot(h, 1) ^ rot(u[i], size) ^ u[i + size]
        grams.append(h)
    width = min(w, len(grams))
    picked = {max(range(a, a + width), key=lambda p: (-(grams[p] >> 33), p)) for a in range(len(grams) - width + 1)}
    return [(p, grams[p]) for p in sorted(picked)]


def check_fingerprints(spark, docs, order):
    """compare() on the rows of docs, which follow each other as in `order`, against the definition."""
    lower = {t: low for t, low in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.lower(F.coalesce("text", F.lit(""))).alias("low")).distinct().collect()}
    edited = {}
    for i, (_, t) in enumerate(order):
        own, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited[i] = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
    for t, low in spark.createDataFrame([(t,) for t in edited.values()], "t string").distinct().select("t", F.lower("t")).collect():
        lower[t] = low
    units = sorted({u for low in lower.values() for u in units_of(low)})
    hash_of = {r.u: r.h for r in spark.createDataFrame([(u,) for u in units] or [("",)], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    of = {t: fingerprint(low, hash_of) for t, low in lower.items()}
    text = lambda f: " ".join(f"{p}:{h:X}" for p, h in f)

    def like(x, y):
        a, b = {h for _, h in x}, {h for _, h in y}
        return len(a & b) / len(a | b) if a | b else 1.0

    want = []
    for i, (d, t) in enumerate(order):
        own, e, after = of[t or ""], of[edited[i]], of[order[(i + 1) % len(order)][1] or ""]
        want.append((d, len(t or ""), sha256(edited[i].encode()).hexdigest(), text(own), text(e), round(like(own, e), 9), round(like(own, after), 9)))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in winnow.compare(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    return of


def test_winnowing_equals_its_definition(spark):
    r = random.Random(3)
    shared = prose(r, winnow.K + winnow.W - 1)
    texts = HARD + [prose(r, 40, 5), f"{prose(r, 30)} {shared} {prose(r, 12)}", f"{prose(r, 9)} {shared} {prose(r, 33)}", "ab " * 30, "中文字符没有空格所以每个字都是一个单位" * 3, "x" * 24, "y" * 25, "z" * 47, "q" * 49 + " 中a" + "b" * 30, "word " * 60_000]
    of = check_fingerprints(spark, frame(spark, texts), list(enumerate(texts)))
    a, b = ({h for _, h in of[texts[len(HARD) + i]]} for i in (1, 2))
    assert a & b
    for t in texts:  # every window has a selected gram
        places, n = [p for p, _ in of[t or ""]], max(0, len(units_of((t or "").lower())) - winnow.K + 1)
        assert all(any(x <= p < x + winnow.W for p in places) for x in range(0, min(n, 300) - winnow.W + 1))


def test_winnowing_of_repeated_and_null_ids_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET", 3)
    monkeypatch.setattr(winnow, "GROUPS", 5)
    rows = [(i * 7 % 101, f"t{i} " * 3 + "and some more words") for i in range(40)] + [(21, "a b"), (21, "a b"), (21, "zz"), (None, "n1 n2"), (None, None), (None, "n0")]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, grams int").repartition(5)
    check_fingerprints(spark, docs, order)
    assert winnow.compare(docs.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(4)
    sound = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "é", "tion"]}
    texts, langs = {}, {}
    for i in range(240):
        lang = sorted(sound)[i % 3]
        texts[i], langs[i] = " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang
    docs = frame(spark, texts, langs)
    model = langid.fit(langid.train_rows(docs))
    assert model.langs == ["aa", "bb", "cc"] and all(f < 0.01 for f in model.false)
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in texts) >= 0.98 * len(texts)
    hard = {x.doc_id: x.lang_pred for x in langid.predict(frame(spark, [None, "", "12 -", "xq", "🙂"]), model).collect()}
    assert [hard[i] for i in (0, 1, 2, 4)] == ["und"] * 4 and hard[3] in model.langs
    assert langid.keep_known(frame(spark, [None, "1", "toka"]), model).count() == 1
    assert langid.predict(docs, langid.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.5) == rows.predicted.astype(bool)).all() and rows.score.between(0, 1).all()
    assert (rows.predicted == rows.quality).mean() > 0.95
    hard = quality.score(frame(spark, HARD), labels.limit(0)).collect()
    assert all(x.score == 0.5 and x.predicted == 1 for x in hard)


def test_quality_statistics_of_hard_texts():
    for t in HARD:
        x = quality.statistics(t)
        assert len(x) == quality.D and np.isfinite(x).all()


def linked_vectors(rows, least=0.95):
    """(links of each row, component of each row) by brute force over all pairs of rows, in order."""
    unit = []
    for _, v in rows:
        ok = v is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least and rows[i][0] is not None and rows[j][0] is not None:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    name = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            name[top(i)] = min(name.get(top(i), k), k)
    return n, [name.get(top(i)) for i in range(len(rows))]


def embedding_rows(seed):
    g = np.random.default_rng(seed)
    base, other = g.normal(size=(60, 16)), g.normal(size=(9, 6))
    v = np.vstack([base, base[:20] + 0.04 * g.normal(size=(20, 16)), base[0] + 0.05 * g.normal(size=(40, 16)), base[5:6], 2 * base[6:7]]).astype(np.float32)
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)]
    rows += [(300 + i, [float(a) for a in x.astype(np.float32)]) for i, x in enumerate(np.vstack([other, other[:3], other[4:6] + 0.01]))]  # another dimension
    rows += [(7, rows[0][1]), (7, rows[30][1]), (7, rows[7][1])]  # one id, other vectors and its own again
    return rows + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [-0.0, 1.0]), (906, [0.0, 1.0]), (907, []), (None, rows[1][1])]


@pytest.mark.parametrize("block", [8, 8192])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    rows = embedding_rows(1)
    monkeypatch.setattr(embed_dup, "BLOCK", block)
    monkeypatch.setattr(embed_dup, "TILE", 3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, component int")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dup.near_duplicates(df).collect())
    n, component = linked_vectors(rows)
    want = collections.Counter((k, x, c, k == c) for (k, _), x, c in zip(rows, n, component))
    assert sum((got & want).values()) >= len(rows) - 1  # recall of the index
    assert sum(r[1] * k for r, k in got.items()) <= sum(n)
    assert embed_dup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_pairs_at_the_threshold_are_decided_in_double_precision(spark):
    g = np.random.default_rng(3)
    rows = []
    for i in range(60):
        x, u = g.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        u -= (u @ x) * x
        u /= np.linalg.norm(u)
        cos = 0.95 + (i - 30) * 1e-7
        rows += [(2 * i, x.tolist()), (2 * i + 1, (cos * x + np.sqrt(1 - cos * cos) * u).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dup.near_duplicates(df).collect()}
    assert got == dict(zip(range(120), linked_vectors(rows)[0]))


def test_repeated_passages_go_and_clean_texts_stay(spark):
    r = random.Random(8)
    passage = prose(r, 51, 10**6)
    line = prose(r, 70, 10**6)
    near = line.split()
    near[30] = "changed"
    clean = {i: "\n".join(prose(r, 30, 10**6) for _ in range(4)) + "\nAll rights reserved.\n" + prose(r, 30, 10**6) for i in range(20)}
    texts = dict(clean)
    for i in (30, 31, 32):
        texts[i] = f"{prose(r, 20, 10**6)} {passage} {prose(r, 25, 10**6)}\n{prose(r, 5, 10**6)}"
    texts[40], texts[41] = f"{prose(r, 9, 10**6)}\n{line}\n{prose(r, 9, 10**6)}", f"{prose(r, 9, 10**6)}\n{' '.join(near)}\n{prose(r, 9, 10**6)}"
    texts[50] = texts[30]
    texts |= {60 + i: t for i, t in enumerate(HARD)}
    docs = frame(spark, texts)
    got = collections.defaultdict(list)
    for x in substring_dup.spans(docs).collect():
        got[x.doc_id].append(x)
    assert set(got) == {31, 32, 41, 50}
    assert all(x.kept_doc_id == 30 for i in (31, 32, 50) for x in got[i])
    out = {x.doc_id: x.text for x in substring_dup.remove(docs).collect()}
    assert all(out[i] == texts[i] for i in clean) and out[30] == texts[30]
    assert passage not in out[31] and passage not in out[32] and "changed" not in out[41]
    assert {i for i in texts if i >= 60} <= set(out) and out[67] == HARD[7]
    assert substring_dup.remove(docs.limit(0)).count() == 0


def test_cut():
    assert substring_dup.cut("a b  c\nd e", [(1, 3)]) == "a d e" and substring_dup.cut("a b", [(0, 2)]) == "" and substring_dup.cut("a b", [(1, 9)]) == "a "


def test_licenses(spark):
    r = random.Random(9)
    apache, gpl, mit = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["GPL-3.0"], licenses.TEMPLATES["MIT"]
    w = mit[1].split()
    w[20] = "changed"
    texts = [f"{prose(r, 30)} {apache[0]} {prose(r, 30)}", gpl[0].upper(), f"{prose(r, 200)}\n{' '.join(w)}\n{prose(r, 7)}", "All rights reserved.", prose(r, 300), f"{apache[0]} {apache[0]}"] + HARD
    got = collections.Counter((x.doc_id, x.license) for x in licenses.scan(frame(spark, texts)).collect())
    assert got == {(0, "Apache-2.0"): 1, (1, "GPL-3.0"): 1, (2, "MIT"): 1, (5, "Apache-2.0"): 2}


def test_mixture_budgets():
    supply = {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 1000}
    got = mixture.budgets(supply, 400, [{"a": 0.5, "b": 0.5}, {}, {}], 1)
    assert got == {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 240}
    got = mixture.budgets(supply, 100, [{"a": 3, "b": 1}, {}, {}], 1)  # the shortage of a leaf goes to its sibling first
    assert got == {("a", "x", "1"): 27, ("a", "x", "2"): 10, ("a", "y", "1"): 37, ("b", "x", "1"): 25}
    assert mixture.budgets({}, 10, [{}, {}, {}], 1) == {}


def test_mixture_takes_prefixes_of_epochs(spark):
    from hashlib import md5

    r = random.Random(10)
    texts = {i: prose(r, r.randint(1, 40)) for i in range(200)} | {900: None, 901: ""}
    docs = frame(spark, texts, {i: ["en", "de", None][i % 3] for i in texts}).withColumn("source", F.when(F.col("doc_id") < 70, "src0").otherwise(F.col("source")))
    rows = mixture.copies(docs, mixture.domain_of(), mixture.WEIGHTS, budget=0.7, epochs=2).collect()
    leaves = collections.defaultdict(list)
    for x in rows:
        leaves[(x.domain, x.lang or "(none)", x.source)].append(x)
    supply = {k: sum(x.n_tokens for x in v) for k, v in leaves.items()}
    want = mixture.budgets(supply, int(0.7 * sum(supply.values())), mixture.WEIGHTS, 2)
    for k, v in leaves.items():
        full, rest = divmod(want[k], supply[k]) if supply[k] else (0, 0)
        place = lambda x: md5(f"7:{full}:{x.doc_id}".encode()).hexdigest()
        total, taken = 0, set()
        for x in sorted(v, key=place):
            total += x.n_tokens
            if rest and total <= rest:
                taken.add(x.doc_id)
            elif total > rest:
                break
        assert {x.doc_id: x.copies for x in v} == {x.doc_id: full + (x.doc_id in taken) for x in v}
    assert mixture.mixed(docs).columns == docs.columns
    assert mixture.mixed(docs.limit(0)).count() == 0


def test_mixture_leaves_columns_alone_and_takes_hard_rows(spark):
    rows = [(i, f"w{i} " * (i % 9), "en", f"src{i % 3}", "MINE", 9, 77) for i in range(60)] + [(None, "a b", None, None, None, None, None)] * 2 + [(5, "w5 " * 5, "en", "src2", "MINE", 9, 77), (61, "w " * 300_000, "de", "src9", "MINE", 9, 77)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, domain string, copies int, n_tokens int")
    for leaves in (100_000, 1):
        mixture.LEAVES, old = leaves, mixture.LEAVES
        try:
            out = mixture.mixed(docs, budget=1.999, epochs=2).collect()
        finally:
            mixture.LEAVES = old
        seen = collections.Counter(map(tuple, out))
        assert set(seen) <= set(rows) and all(r[4:] in (("MINE", 9, 77), (None, None, None)) for r in seen)
        assert set(seen) == set(rows)
    both = {r.doc_id: r.copies for r in mixture.copies(docs, mixture.domain_of(), mixture.WEIGHTS, budget=1.999).collect()}
    assert all(seen[r] == (2 if rows.count(r) == 2 else 1) * both[r[0]] for r in rows)


def test_license_siblings_are_told_apart(spark):
    r = random.Random(12)
    gnu = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    bsd = licenses.TEMPLATES["BSD-2-Clause"][0].split()
    bsd[60] = "changed"
    notices = {
        "GPL-2.0": gnu.format("program", "General Public License", 2),
        "LGPL-3.0": gnu.format("library", "Lesser General Public License", 3),
        "AGPL-3.0": gnu.format("program", "Affero General Public License", 3),
        "MPL-2.0": licenses.TEMPLATES["MPL-2.0"][0],
        "ISC": licenses.TEMPLATES["ISC"][0],
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "BSD-2-Clause": " ".join(bsd),
        "BSD-3-Clause": licenses.TEMPLATES["BSD-3-Clause"][0],
    }
    rows = licenses.scan(frame(spark, [f"{prose(r, 30)} {t} {prose(r, 30)}" for t in notices.values()])).collect()
    assert sorted((x.doc_id, x.license) for x in rows) == list(enumerate(notices))


def test_language_grams_do_not_depend_on_the_place_in_a_slice():
    texts = ["hi", "hi", None, "", "a bc", "hi", "12 hi!"]
    h, owner, _ = langid.grams(texts)
    for i, t in enumerate(texts):
        assert h[owner == i].tolist() == langid.grams([t])[0].tolist()
    assert (owner == 5).sum() == 1


def test_filters_of_more_than_64_languages():
    names = [f"l{k:03}" for k in range(150)]
    texts = ["".join(chr(0x4E00 + 50 * k + i) for i in range(40)) for k in range(150)]
    model = langid.Filters(names, [langid.grams([t])[0] for t in texts])
    assert model.predict(texts)[0] == names and model.predict(["1"])[0] == ["und"]


def test_near_passages_across_and_inside_lines(spark):
    r = random.Random(21)
    fresh = lambda n: prose(r, n, 10**6)
    texts, edits = {}, {10: lambda w: w[:35] + ["changed"] + w[36:], 20: lambda w: w[:35] + ["added"] + w[35:], 30: lambda w: w[:35] + w[36:]}
    for i, edit in edits.items():
        w = fresh(72).split()
        wrap = lambda x: "\n".join(" ".join(x[k : k + 12]) for k in range(0, len(x), 12))
        texts[i], texts[i + 1] = f"{fresh(20)}\n{wrap(w)}\n{fresh(15)}", f"{fresh(8)}\n{wrap(edit(w))}\n{fresh(30)}"
    w = fresh(72).split()
    texts[40], texts[41] = f"{fresh(400)} {' '.join(w)} {fresh(300)}", f"{fresh(100)} {' '.join(edits[10](w))} {fresh(500)}"
    rows = substring_dup.spans(frame(spark, texts)).collect()
    assert {(x.doc_id, x.kept_doc_id) for x in rows} == {(11, 10), (21, 20), (31, 30), (41, 40)}
    assert all(50 <= x.n_words <= 73 for x in rows)
