"""Token ids of whole texts by a public byte-level tokenizer.

The library splits a text by the vocabulary's pattern and merges bytes within each
part.  Long texts are first cut where the pattern always begins a new part: before
white space that follows a letter, digit or punctuation mark.  A stretch without
such a place, which the library's backtracking pattern engine may not survive, is
split by a linear engine into the same parts and merged part by part.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; every function takes another path.
VOCAB_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Texts of more characters are cut at safe places into pieces of about this length.
PIECE_CHARS = 65_536
#: The pattern of the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


class Encoder:
    """Encodes and decodes with the ranks of one file; built once per Python worker."""

    def __init__(self, path: str, piece_chars: int = PIECE_CHARS) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.piece_chars = piece_chars
        self.safe = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")
        self.part = regex.compile(PATTERN)

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut at safe places into pieces of at least ``piece_chars`` characters, where there are such places."""
        start = 0
        while len(text) - start > self.piece_chars:
            cut = self.safe.search(text, start + self.piece_chars)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; empty for null and empty texts."""
        if not text:
            return []
        if len(text) <= self.piece_chars:
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces(text):
            if len(piece) <= 2 * self.piece_chars:
                ids += self.bpe.encode_ordinary(piece)
            else:
                for part in self.part.finditer(piece):
                    ids += self.bpe._encode_single_piece(part.group())
        return ids

    def decode(self, ids) -> str:
        """The text of ``ids``: their raw bytes joined, then read as UTF-8 once, so characters split over tokens survive."""
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", errors="replace")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _path(vocab: str | None) -> str:
    return vocab or os.path.join(VOCAB_DIR, RANK_FILE)


def token_ids(text: Column, vocab: str | None = None) -> Column:
    """``array<int>`` of the ids of a text column; empty for null and empty texts."""
    path = _path(vocab)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([enc.encode(t) for t in s])

    return ids(text)


def token_count(text: Column, vocab: str | None = None) -> Column:
    """Number of ids of a text column; 0 for null and empty texts."""
    path = _path(vocab)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([len(enc.encode(t)) for t in s], dtype="int64")

    return count(text)


def decoded(ids: Column, vocab: str | None = None) -> Column:
    """The text of an ``array<int>`` column of ids; null ids give null."""
    path = _path(vocab)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([None if i is None else enc.decode(i) for i in s], dtype=object)

    return text(ids)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """``id_col, ids`` of every row, repeated ids included: texts as they are, nothing normalized, trimmed or dropped.

    One narrow pass without a shuffle; other columns are not read.
    """
    return documents.select(F.col(id_col), token_ids(F.col(text_col), vocab).alias("ids"))
