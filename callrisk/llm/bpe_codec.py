"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from the ranks.

The rank vocabulary becomes a sentencepiece BPE model without any training: piece i is token i with
every byte written as one private character, its score is minus its rank, and the normaliser is the
identity.  Sentencepiece merges the pair with the highest score first, leftmost on ties, which is the
rank order of the byte-level vocabulary.  Pre-tokens are encoded one by one; one that is itself in the
vocabulary is that token without a merge (as the rank library has it, also where merging would give
another split).  Decoding maps pieces back to bytes.

Defined results: null text is empty text (no ids); empty text has no ids and decodes to empty bytes;
repeated rows and ids give one row each; extra input columns are left out; an empty table gives an
empty result.  Very long texts are handled whole; one pre-token is never cut.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
from pyspark.sql import DataFrame

from . import pretokens
from .arrays import offsets_of, pieces, ragged_index, utf8
from .tasks import binary, map_arrow, texts

#: Character of byte b is chr(_FIRST + b): no white space, nothing sentencepiece treats specially.
_FIRST = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """Token byte strings of a rank file (base64 token, blank, rank), in rank order."""
    with open(path, "rb") as f:
        rows = sorted((int(r), base64.b64decode(t)) for t, r in (x.split() for x in f if x.strip()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [t for _, t in rows]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as 32 bit, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def characters(token: bytes) -> str:
    """A byte string with one private character for each byte."""
    return (token.decode("latin-1")).translate(_TO_PRIVATE)


_TO_PRIVATE = {b: chr(_FIRST + b) for b in range(256)}


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """Serialised sentencepiece model: fixed field numbers of its public model format."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, characters(token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encoder of one worker process."""

    def __init__(self, tokens: list[bytes], model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: [i] for i, t in enumerate(tokens)}
        self.table = pretokens.classes("tiktoken")
        self.pool = pretokens.TokenPool(self._encode)

    def _encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A pre-token that is itself in the vocabulary is that token, the others are merged."""
        ids = [self.whole.get(t) for t in tokens]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.pieces.encode([characters(tokens[i]) for i in rest], num_threads=1)):
            ids[i] = x
        return pretokens.concatenated(ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, concatenated, and ids per row."""
        piece = pretokens.Piece(data, offsets, self.table)
        entry = self.pool.lookup(piece.tokens)[piece.which] if len(piece.which) else piece.which
        size = np.diff(self.pool.offsets)[entry]
        ids = self.pool.flat[ragged_index(self.pool.offsets[entry], size)]
        return ids, np.bincount(piece.row, size, piece.rows).astype(np.int64)


class Decoder:
    """Inverse of the byte mapping: the bytes of each id, back to back."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = offsets_of(self.length)[:-1]

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the offset of each id's bytes."""
        size = self.length[ids]
        return self.flat[ragged_index(self.start[ids], size)], offsets_of(size)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str, tokens: list[bytes], model: bytes) -> Encoder:
    """The worker's encoder of a vocabulary; a worker keeps one."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(tokens, model)
    return _ENCODERS[vocabulary]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit) for every row of ``df``.

    One pass over the text without a shuffle; the vocabulary (a fixed file of about a megabyte) goes
    to the tasks with the function.
    """
    tokens = read_ranks(vocabulary)
    model = sentencepiece_model(tokens)

    def run(batch):
        encoder = _encoder(vocabulary, tokens, model)
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            ids, count = encoder(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield {id_col: batch.column(0).slice(a, b - a), "n_tokens": count,
                   "ids": binary(4 * offsets_of(count), ids.astype("<u4"))}

    return map_arrow(texts(df, id_col, text_col), run, [(id_col, df.schema[id_col].dataType),
                                                        ("n_tokens", "long"), ("ids", "binary")])


def transcode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ``decode(encode(df))`` in one Python stage, so that a task has one worker."""
    tokens = read_ranks(vocabulary)
    model = sentencepiece_model(tokens)
    decoder = Decoder(tokens)

    def run(batch):
        encoder = _encoder(vocabulary, tokens, model)
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            ids, count = encoder(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            written = ids.astype("<u4")
            bounds = offsets_of(count)
            decoded, at = decoder(np.frombuffer(written.tobytes(), "<u4"))
            yield {id_col: batch.column(0).slice(a, b - a), "n_tokens": count, "ids": binary(4 * bounds, written),
                   "decoded": binary(at[bounds], decoded)}

    return map_arrow(texts(df, id_col, text_col), run,
                     [(id_col, df.schema[id_col].dataType), ("n_tokens", "long"), ("ids", "binary"),
                      ("decoded", "binary")])


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids, decoded binary) for rows of little-endian unsigned 32-bit ids; null ids
    decode to empty bytes.  Columns of ``df`` with these names are replaced, others left out."""
    decoder = Decoder(read_ranks(vocabulary))

    def run(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in pieces(offsets):
            body = data[offsets[a]:offsets[b]]
            ids = np.frombuffer(body.tobytes(), "<u4")
            bounds = (offsets[a:b + 1] - offsets[a]) // 4
            decoded, at = decoder(ids)
            yield {id_col: batch.column(0).slice(a, b - a), "n_tokens": np.diff(bounds),
                   ids_col: binary(4 * bounds, body), "decoded": binary(at[bounds], decoded)}

    return map_arrow(df.select(id_col, ids_col), run,
                     [(id_col, df.schema[id_col].dataType), ("n_tokens", "long"), (ids_col, "binary"),
                      ("decoded", "binary")])
