"""Operator 10: language identification by bit-sliced Bloom filters of character n-grams.

Slot i of the filter holds a mask of 64-bit words with a bit for every language that has set slot i, so the AND of an n-gram's
slots names all languages that contain it. A text's language is the one with most n-grams after the expected number
of false positives is taken off.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, mix, over_rows

N = 4
SLOTS = 1 << 18
HASHES = 3
#: Bound of the fit: about so many documents a language, chosen by a hash, and so many of their n-grams.
DOCS_PER_LANG = 1000
GRAMS_PER_LANG = 6000
#: Bytes of text whose n-grams are in memory at a time: arrays take about 50 times as many.
SLICE = 1 << 19
#: Languages that one word of a mask holds.
WORD = 64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams, text number of each, letters of each text) over letters and single gaps."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), "<u4") if t else np.zeros(0, "<u4") for t in texts]
    sizes = np.array([len(c) for c in codes])
    all_codes = np.concatenate(codes) if codes else np.zeros(0, "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _letters()[all_codes]
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    all_codes = np.where(letter, all_codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other signs the first alone stays
    keep[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = True  # each text has its own leading gap
    c, owner = all_codes[keep].astype(np.uint64), owner[keep]
    if len(c) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), n_letters
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x110003) + c[i : len(c) - n + 1 + i]
    same = owner[: len(h)] == owner[n - 1 :]
    return mix(h[same]), owner[: len(h)][same], n_letters


def slots(h: np.ndarray, i: int, size: int = SLOTS) -> np.ndarray:
    return ((h >> np.uint64(20 * i)) & np.uint64(size - 1)).astype(np.int64)


class Filters:
    """The fitted model: learned languages, masks by slot, false positive rate by language."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray], size: int = SLOTS):
        self.langs, self.masks = langs, np.zeros((max(1, -(-len(langs) // WORD)), size), np.uint64)
        for k, g in enumerate(grams_of):
            for i in range(HASHES):
                np.bitwise_or.at(self.masks[k // WORD], slots(g, i, size), np.uint64(1 << k % WORD))
        self.false = np.array([float(self._bits(self.masks, k).mean()) ** HASHES for k in range(len(langs))])

    @staticmethod
    def _bits(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        h, owner, letters = grams(texts)
        size = self.masks.shape[1]
        hit = self.masks[:, slots(h, 0, size)]
        for i in range(1, HASHES):
            hit &= self.masks[:, slots(h, i, size)]
        total = np.bincount(owner, minlength=len(texts))
        got = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            bit = self._bits(hit, k).astype(bool)
            got[:, k] = np.bincount(owner[bit], minlength=len(texts))
        got = np.maximum(0, (got - total[:, None] * self.false) / (1 - self.false))
        best = got.argmax(1) if self.langs else np.zeros(len(texts), int)
        top = got.max(1) if self.langs else np.zeros(len(texts))
        score = np.where(got.sum(1) > 0, top / np.maximum(got.sum(1), 1e-12), 0.0)
        und = (letters == 0) | (not self.langs)
        return ["und" if u else self.langs[b] for u, b in zip(und, best)], np.where(und, 0.0, score).tolist()


def fit(train: DataFrame, docs_per_lang: int = DOCS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> Filters:
    """Learns from (doc_id, text, lang). Rows with a null lang or text are left out; no row at all gives no language.
    Repeated rows count as often as they come.

    The fit's bound: about docs_per_lang documents of each language, whole texts, and their grams_per_lang most
    frequent n-grams. Only those n-grams, a bounded number, come to the driver.
    """
    train = train.where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return Filters([], [])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_lang / n))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = train.where(unit < F.element_at(share, F.col("lang"))).select("text", "lang")

    def make():
        def work(text, lang):
            keys, values, numbers = [], [], []
            names = sorted(set(lang))
            h, owner, _ = grams(text)
            which = np.array([names.index(x) for x in lang])[owner] if len(owner) else owner
            for k, name in enumerate(names):
                g, n = np.unique(h[which == k], return_counts=True)
                keys += [name] * len(g)
                values.append(g.view(np.int64))
                numbers.append(n)
            return {"lang": keys, "gram": np.concatenate(values), "n": np.concatenate(numbers)}

        return work

    seen = over_rows(sample, ["text", "lang"], "lang string, gram bigint, n bigint", make, SLICE)
    ranked = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= grams_per_lang).select("lang", "gram").collect()
    langs = sorted(counts)
    of: dict[str, list[int]] = {x: [] for x in langs}
    for r in rows:
        of[r.lang].append(r.gram)
    return Filters(langs, [np.array(of[x], np.int64).view(np.uint64) for x in langs])


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text in one narrow pass.

    `und` and 0 for a null text and for one without a letter; a text whose n-grams no filter knows gets the first
    language with score 0; ties go to the first language in alphabetical order. Repeated rows and rows without doc_id
    have a row each; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for each 64 languages, whatever the input

    def make():
        m = shared.value

        def work(doc_id, text):
            lang, score = m.predict(text)
            return {"doc_id": doc_id, "lang_pred": lang, "score": score}

        return work

    return over_rows(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double", make, SLICE)


def keep_known(docs: DataFrame, model: Filters) -> DataFrame:
    """docs without the rows whose prediction is `und`; decided in place, so no text is shuffled.

    Null texts and texts without a letter go; with a model of no language all rows go. Repeated rows and rows without
    doc_id are decided each by its text; an empty table stays empty; columns of any name stay as they are.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(*columns):
            out = dict(zip(names, columns))
            keep = [i for i, lang in enumerate(m.predict(out["text"])[0]) if lang != "und"]
            return {c: [v[i] for i in keep] for c, v in out.items()}

        return work

    return over_rows(docs, names, schema, make, SLICE)


def held_out() -> F.Column:
    return F.coalesce(crc_fold("doc_id") == 1, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())
