"""Summaries and embeddings from outside services, called by executors in batches."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V


class StubProvider:
    """Deterministic answers without a network, for tests and dry runs."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(sha256(f"{i}:{model}:{t}".encode()).digest() for i in range(-(-self.dim // 32)))
            out.append([b / 127.5 - 1 for b in raw[: self.dim]])
        return out

    def summarize(self, prompts: list[str], model: str) -> list[tuple[str, int]]:
        return [(p.split("\n")[0], len(p.split())) for p in prompts]


@dataclass
class HttpProvider:
    """A service with the widespread /embeddings and /chat/completions interface."""

    endpoint: str
    api_key: str = ""
    dimension: int | None = None
    timeout: float = 30

    def post(self, path: str, body: dict) -> dict | list:
        request = urllib.request.Request(f"{self.endpoint.rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def body(self, texts: list[str], model: str) -> dict:
        """bge models take no `dimensions`."""
        out: dict = {"model": model, "input": texts}
        if self.dimension and "bge" not in model.lower():
            out["dimensions"] = self.dimension
        return out

    @staticmethod
    def vectors(answer: dict | list) -> list[list[float]]:
        """From {data: [{embedding}]}, {embedding}, {embeddings} or a bare list."""
        if isinstance(answer, list):
            return answer if answer and isinstance(answer[0], list) else [answer]
        if "data" in answer:
            return [x["embedding"] for x in answer["data"]]
        return answer["embeddings"] if "embeddings" in answer else [answer["embedding"]]

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        return self.vectors(self.post("embeddings", self.body(texts, model)))

    def summarize(self, prompts: list[str], model: str) -> list[tuple[str, int]]:
        out = []
        for p in prompts:
            a = self.post("chat/completions", {"model": model, "messages": [{"role": "user", "content": p}]})
            out.append((a["choices"][0]["message"]["content"].strip(), a.get("usage", {}).get("total_tokens", 0)))
        return out


def retried(call: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep):
    """call(), up to `attempts` more times, with a pause of one more second each time."""
    for k in range(attempts + 1):
        try:
            return call()
        except Exception:
            if k == attempts:
                raise
            wait(float(k + 1))


def _each(rows: DataFrame, schema: str, size: int, answer: Callable[[list[str]], list[dict]], attempts: int) -> DataFrame:
    """answer(texts) for batches of `size`; where a batch fails, its rows are asked one by one and keep their error."""

    def one(texts: list[str]) -> list[dict]:
        try:
            return retried(lambda: answer(texts), attempts)
        except Exception as e:
            if len(texts) > 1:
                return [one([t])[0] for t in texts]
            return [{"error": f"{type(e).__name__}: {e}"[:500]}]

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                got = one(part["text"].tolist())
                data = [{n: None for n in names} | {"symbol_id": int(i), "chunk_hash": h} | g for i, h, g in zip(part["symbol_id"], part["chunk_hash"], got)]
                yield pd.DataFrame({n: pd.Series([d[n] for d in data], dtype=object) for n in names})

    return rows.select("symbol_id", "chunk_hash", "text").mapInPandas(run, schema)


def chunks(symbols: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """Symbols with their code and its hash as new_hash. contents: path, content."""
    met = symbols.join(files.select("file_id", "path"), "file_id").join(contents.select("path", "content"), "path")
    return met.withColumn("code", T.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).withColumn("new_hash", F.sha2("code", 256)).drop("content")


def summarize(symbols: DataFrame, files: DataFrame, contents: DataFrame, provider, model: str = "gpt-4o-mini", size: int = 5, attempts: int = 3) -> DataFrame:
    """(symbol_id, chunk_hash, summary, tokens, error) for symbols without a summary or with a changed chunk."""
    found = chunks(symbols, files, contents)
    todo = found.where(F.col("chunk_summary").isNull() | ~F.col("chunk_hash").eqNullSafe(F.col("new_hash")))
    rows = todo.select("symbol_id", F.col("new_hash").alias("chunk_hash"), T.prompt(F.col("kind"), F.col("qualified_name"), F.col("code")).alias("text"))
    return _each(rows, "symbol_id bigint, chunk_hash string, summary string, tokens int, error string", size, lambda ts: [{"summary": s, "tokens": n} for s, n in provider.summarize(ts, model)], attempts)


def embed(todo: DataFrame, provider, model: str, now: int, size: int = 5, attempts: int = 3) -> DataFrame:
    """Embedding rows (and an error column) for symbols; vectors are normalised, zero vectors stay."""
    rows = todo.select("symbol_id", "chunk_hash", T.embed_text(F.col("chunk_summary"), F.col("qualified_name")).alias("text"))
    got = _each(rows, "symbol_id bigint, chunk_hash string, vector array<double>, error string", size, lambda ts: [{"vector": v} for v in provider.embed(ts, model)], attempts)
    unit = V.normalize(F.col("vector")).cast("array<float>")
    at = F.lit(now).cast("bigint")
    return got.select("symbol_id", F.lit(model).alias("model"), F.size("vector").alias("dim"), unit.alias("embedding"), "chunk_hash", at.alias("created_at"), at.alias("updated_at"), "error")
