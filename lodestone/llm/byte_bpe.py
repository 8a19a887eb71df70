"""Byte-level BPE as a monoid: (text, ids) under a join that mends the border.

A text is encoded by halves. Two neighbours are joined by encoding again a window around the border, which grows on
either side until it ends at a seam: a place between a character that is no white space and an ASCII blank, tab or
line end. No match of the pattern runs over a seam (only a leading blank goes before other characters, none comes
after them), and its one look-ahead is tried behind white space only, so the tokens before a seam depend on the text
before it and those after it on the text after it: outside the window they are proved stable. The identity is
("", []), the join is associative, and so any tree over the text gives the same ids.

Decoding concatenates the bytes of the ids up such a tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import ready, table, texts

SEAM = re.compile(r"(?<=\S)(?=[ \t\r\n])")
BLANKS = " \t\r\n"
#: Characters of a leaf, encoded in one call, and ids of a leaf of the decoding tree.
LEAF = 256
#: Characters on either side of a border that are tried first.
WINDOW = 32


class Codec:
    """The ids of a rank file, and the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """The ids of text[start:end], from those of text[start:middle] and text[middle:end]."""
        if start == middle or middle == end:
            return left + right
        if text[middle] in BLANKS and not text[middle - 1].isspace():
            return left + right
        a, size = start, window
        while (low := middle - size) > start:
            if seams := [m.start() for m in SEAM.finditer(text, low, middle)]:
                a = seams[0]
                break
            size *= 2
        b, size = end, window
        while (high := middle + size) < end:
            if seam := SEAM.search(text, middle + 1, high):
                b = seam.start()
                break
            size *= 2
        kept = left[: len(left) - len(self.leaf(text[a:middle]))]
        return kept + self.leaf(text[a:b]) + right[len(self.leaf(text[middle:b])) :]

    def encode(self, text: str, start: int = 0, end: int | None = None, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        end = len(text) if end is None else end
        if end - start <= leaf:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        left, right = self.encode(text, start, middle, leaf, window), self.encode(text, middle, end, leaf, window)
        return self.join(text, start, middle, end, left, right, window)

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


@lru_cache(maxsize=2)
def load_codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ids array<int>.

    A null text counts as empty and has no ids; repeated rows and null ids are kept; further columns are ignored; an
    empty table gives an empty result. Texts may be of any length.
    """
    return _mapped(docs, id_col, text_col, "ids array<int>", path, pattern, lambda codec, text: {"ids": codec.encode(text)})


def decode_ids(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id and decoded binary; null ids decode to no bytes."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "decoded": [b"" if ids is None else codec.decode(list(ids)) for ids in batch["ids"]]})

    rows = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(codec: Codec, text: str) -> dict:
    ids = codec.encode(text)
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(" ".join([codec.decimal[i] for i in ids]).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(codec.decode(ids)).hexdigest(),
    }


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encode_texts and of decode_ids on its ids, in one pass, so that no ids are moved or stored:
    doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls, repeats and empty tables as in encode_texts.
    """
    return _mapped(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, digests)


def _mapped(docs: DataFrame, id_col: str, text_col: str, columns: str, path: str, pattern: str, of_text) -> DataFrame:
    ready(docs.sparkSession)
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(path, pattern)
        for batch in batches:
            # Ids are made for some hundred texts at a time.
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = [of_text(codec, text) for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].tolist()} | {n: [r[n] for r in rows] for n in names}) if len(part) else part

    rows = texts(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return round_trip(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
