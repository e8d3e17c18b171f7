"""Token ids of whole texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Fixed values of the word_bpe file: its split pattern, for characters below U+0100 only.
_LETTERS = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: Texts with any other character go through the tokenizer whole. Left out below U+0100 are
#: control characters and the signs that Unicode counts as letters or numbers.
_OTHER = re.compile(r"[^\t\n\r -~¡-©«-±´¶-¸»¿-ÿ]|<\|")
#: Characters that stand for the bytes without a visible one, in the order of the bytes.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = dict(zip([x for x in range(256) if x not in _VISIBLE], range(256, 512)))
#: Most pieces that a worker remembers.
MEMO_PIECES = 600_000


class _Pieces(dict):
    """Ids of pieces, found by the tokenizer's model when they are first seen."""

    def __init__(self, tokenizer, width: str):
        self.model, self.code = tokenizer.model, {"<u2": "H", "<u4": "I"}[width]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        name = piece
        if not piece.isascii():
            name = piece.encode().decode("latin-1").translate(_BYTE_NAMES)
        ids = array(self.code, [token.id for token in self.model.tokenize(name)]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """``tokenizer.encode(text, add_special_tokens=False).ids``, remembering pieces.

    The tokenizer encodes each piece of its split pattern by itself, so the ids of a text are
    those of its pieces in a row. A lower-cased split is exact for plain Latin texts; other
    texts, and other tokenizers than the word_bpe file, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = os.path.basename(path) == "word_bpe_49k.json" and sys.byteorder == "little"
        self.width = id_width(self.tokenizer)
        self.pieces = _Pieces(self.tokenizer, self.width)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian integers of ``width``."""
        texts = [text or "" for text in texts]
        whole = [i for i, text in enumerate(texts) if not self.by_piece or _OTHER.search(text)]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        others = {i: np.array(one.ids, self.width).tobytes() for i, one in zip(whole, found)}
        get = self.pieces.__getitem__
        return [
            others[i] if i in others else b"".join(map(get, _PIECE.findall(text.lower())))
            for i, text in enumerate(texts)
        ]


def id_width(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoding(path: str, end_id: int):
    """What ``tokenize`` does with Arrow batches of ``doc_id, text``.

    For steps that go on with the ids in the same Python worker: a worker of their own would be
    one more in memory for each running task, and as Spark reuses workers in turn, each would
    come to hold an encoder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.width).tobytes()
        size = len(end)
        for batch in slices(batches):
            ids = [one + end for one in encode(batch["text"].to_pylist())]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": pa.array([len(x) // size for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    return run


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, as ``encoding`` takes them."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text")


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of each text with ``end_id`` at the end.

    A null text counts as empty, so its only id is ``end_id``. Repeated rows stay, as does a
    null doc_id. ``ids`` holds little-endian integers of two bytes, or of four if the
    vocabulary needs them.
    """
    schema = "doc_id bigint, n_tokens bigint, ids binary"
    return texts(docs).mapInArrow(encoding(path, end_id), schema)
