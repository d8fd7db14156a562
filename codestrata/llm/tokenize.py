"""BPE by the tokenizers library, with exact certain cuts, so that repeated pieces are encoded once.

Nothing is trained here. Both encoders return what `Tokenizer.encode(text, add_special_tokens=False).ids` returns.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: White space of the tokenizers' regex (Python's has four control characters besides).
_PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def _load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


#: Letters of Latin-1 and then ASCII signs, among which no apostrophe (contractions) begins anything.
_STEM = re.compile(r"( ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


class Pieces(dict):
    """A memory of encoded pieces in two generations: when the young one is full it becomes the old one, so frequent
    pieces stay. `most` bounds the bytes of a generation, entries' own overhead counted as OVERHEAD each."""

    OVERHEAD = 200

    def __init__(self, most: int = 16 << 20):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def forget(self) -> None:
        """For the end of a task: an idle worker keeps the vocabulary alone."""
        self.clear()
        self.held, self.old = 0, {}

    def make(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        m = _STEM.fullmatch(piece)
        if m:
            return self[m[1]] + self[m[2]]
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            size = len(piece) + len(out) + self.OVERHEAD
            if self.held + size > self.most and self:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[piece] = out
        return out


class WordBpe(Pieces):
    """piece between spaces or line ends -> its ids as little-endian uint32 bytes.

    Of the word tokenizer's rules (NFC, white space dropped, lower case, letters | one digit | other signs) none
    crosses a space or a line end, so the pieces' ids concatenate to the text's. Words of Latin-1 letters alone go
    straight to the model, all others through the whole library.
    """

    def __init__(self, path: str):
        super().__init__(40 << 20)
        self.tok = _load(path)
        self.model, self.map = self.tok.model, byte_chars()

    def make(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) < "\u0100":
            low = piece.lower()
            if not low.isascii():
                low = "".join(map(self.map.__getitem__, low.encode()))
            return np.array([x.id for x in self.model.tokenize(low)], "<u4").tobytes()
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


class ByteBpe(Pieces):
    """piece -> its ids as little-endian uint32 bytes, by forced boundaries.

    A byte pair that stands inside no token of the vocabulary can't be merged, so a cut there is certain. Two uses:
    the text is cut before each run of white space (a cut of the pre-tokenizer too), and each pre-token of a piece
    is cut again at every such pair before the model sees it.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = _load(path)
        self.model, self.pre = self.tok.model, self.tok.pre_tokenizer
        self.map = byte_chars()
        back = {c: b for b, c in enumerate(self.map)}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            b = [back[c] for c in token]
            inside[b[:-1], b[1:]] = True
        self.inside = inside
        self.pairs = {self.map[a] + self.map[b] for a, b in zip(*np.nonzero(inside))}
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def cuts(self, mapped: str) -> list[str]:
        """A pre-token, in byte characters, cut wherever a pair is in no token."""
        out, at = [], 0
        for i in range(1, len(mapped)):
            if mapped[i - 1 : i + 1] not in self.pairs:
                out.append(mapped[at:i])
                at = i
        out.append(mapped[at:])
        return out

    def make(self, piece: str) -> bytes:
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha() and max(letters) < "\u0100":  # one pre-token
            mapped = piece.replace(" ", self.map[32]) if piece.isascii() else "".join(map(self.map.__getitem__, piece.encode()))
            out = [x.id for f in self.cuts(mapped) for x in self.model.tokenize(f)]
        elif piece[0] == "\n" and piece[1:].isalpha():
            return self["\n"] + self[piece[1:]]
        else:
            out = self.ids(piece)
        return np.array(out, "<u4").tobytes()

    def ids(self, piece: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in [*self.split.finditer(piece), None]:
            plain = piece[at : m.start() if m else len(piece)]
            for mapped, _ in self.pre.pre_tokenize_str(plain) if plain else ():
                for fragment in self.cuts(mapped):
                    out += [x.id for x in self.model.tokenize(fragment)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, _PIECE.findall(text or ""))), "<u4")

    def decode(self, ids: list[int]) -> str:
        """As Tokenizer.decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def word_bpe(path: str) -> WordBpe:
    """One encoder a worker process: tasks that follow find its vocabulary and pieces ready."""
    return WordBpe(path)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
