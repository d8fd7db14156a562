"""Operator 5: BPE encoding and decoding with forced boundaries (see tokenize.ByteBpe)."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame

from .common import over_rows
from .tokenize import byte_bpe

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>, text): the ids of every whole text, and the text decoded from them.

    Null texts count as empty and give no ids; repeated rows give repeated rows; other columns are ignored.
    One narrow pass without a shuffle; a worker's memory is bounded by its slice of a batch and its piece cache.
    """

    def make():
        bpe = byte_bpe(tokenizer_path(tokenizer))

        def work(doc_id, text):
            ids = [bpe.encode(t).tolist() for t in text]
            return {"doc_id": doc_id, "ids": ids, "text": [bpe.decode(i) for i in ids]}

        work.close = bpe.forget
        return work

    return over_rows(docs, ["doc_id", "text"], "doc_id bigint, ids array<int>, text string", make)


def digest(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), computed beside the ids so that these never leave the worker.

    Null and empty texts have no tokens and the digests of an empty string; repeated rows and rows without doc_id give
    a row each; an empty table gives none; other columns are ignored. One narrow pass without a shuffle.
    """

    def make():
        bpe = byte_bpe(tokenizer_path(tokenizer))
        names: list[str] = [str(i) for i in range(len(bpe.bytes))]

        def work(doc_id, text):
            out = {"doc_id": doc_id, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in text:
                ids = bpe.encode(t).tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        work.close = bpe.forget
        return work

    return over_rows(docs, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
