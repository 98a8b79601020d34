"""Byte-level BPE through a sentencepiece model written from a rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import slices, text_or_empty
from flockwise.llm.pieces import Cache, encoded, spaced_lists


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where it prints, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()
BYTES = {c: b for b, c in LETTERS.items()}


def lettered(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks of {path} have gaps")
    return [token for _, token in ranked]


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(tag: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _number(tag << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    return _number(tag << 3) + _number(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is token i in letters with score -i; identity normalisation.

    The best-scored pair is merged first, leftmost on ties, as the rank order asks. The unknown
    piece, which such a model must have, comes last and is never produced.
    """
    pieces = [_field(1, lettered(t).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        # the inverse mapping, from the model's own pieces
        self.spelled = [bytes(BYTES[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        whole = {t: i for i, t in enumerate(tokens)}
        found = self.model.encode([lettered(t) for t in tokens], num_threads=1)
        #: Tokens that merging alone doesn't reach; a match equal to one is that token.
        self.direct = {t.decode("latin-1"): i for (t, i), ids in zip(whole.items(), found, strict=True) if ids != [i]}
        self.words = Cache(self._words)
        self.cache = Cache(self._pieces)

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for word, ids in zip(words, self.model.encode([lettered(w.encode()) for w in words], num_threads=1), strict=True):
            one = self.direct.get(word.encode().decode("latin-1")) if self.direct else None
            ids = ids if one is None else [one]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        parts = [self.split(p) for p in pieces]
        names = list({w for p in parts for w in p})
        ids = dict(zip(names, self.words.all(names), strict=True))
        return [b"".join([ids[w] for w in p]) for p in parts]

    def encode(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers, all their ids, and the offsets at which each row's ids start."""
        for rows, lists in spaced_lists(texts):
            ids, ends = encoded(lists, self.cache)
            yield rows, ids, ends

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def byte_bpe(ranks: str, pattern: str) -> ByteBpe:
    """One model for each worker process."""
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of every text and the text decoded from them: ``doc_id``, ``n_tokens``, ``ids`` (binary, unsigned
    32-bit little-endian), ``decoded`` (binary), ``ids_sha256``, ``decoded_sha256``.

    ``keep_ids=False`` leaves out ``ids`` and ``decoded``. Each match of ``pattern`` is encoded
    separately, without special tokens. Tasks are independent; nothing is shuffled.

    A null text counts as empty and has no ids; the id may be null and rows may repeat; each row gives a row.
    Texts of any length are encoded whole. Other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in slices(batches, 1):
            for rows, ids, ends in bpe.encode(batch.column(1).cast(pa.string())):
                coded = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                raw = [c.tobytes() for c in coded]
                decoded = [bpe.decode(c) for c in coded]
                columns = [
                    batch.column(0).take(pa.array(rows)), pa.array(np.diff(ends)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                columns += [pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(run, schema)
