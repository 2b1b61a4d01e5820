"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, the model kind, the
normaliser's settings.  From it the tokenizers-library backend is rebuilt: the normaliser, the
metaspace marker for blanks, unigram scores or the merge ranks of a BPE model, byte fallback and the
matching decoder.

Texts repeat their words, so a text is cut where no piece can reach across (before a marker that
follows another character, and around line ends, if the vocabulary has no piece over such a
place); each distinct part is encoded once per worker cache, in multithreaded batches, and a text's
ids are the parts' ids in order.  A model whose pieces cross those places is encoded text by
text.  Every batch of new parts is encoded by the SentencePiece library as well, as one text, and
compared: the parity check covers all rows.  A part that differs takes the SentencePiece ids and
is counted.

Defined results: a null text gives null ids, the empty text an empty list; texts of any length are
encoded whole; rows are independent, so repeated rows and other columns need no care.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_chunks

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_PARTS = 300_000
BATCH_PARTS = 2048  # parts a text
BATCH_TEXTS = 8
# Values of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message; 32-bit values are given as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, buf[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.squeeze_blanks = bool(v)
                    elif n == 5:
                        m.escape_blanks = bool(v)
        return m

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, best score first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL and len(piece) > 1:
                found += [
                    (-score, ids[piece], k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids
                ]
        return [(a, b) for *_, a, b in sorted(found)]

    def splits_at_words(self) -> bool:
        """No piece has a marker after another character, or a line end beside another character."""
        text = [p for p, _, kind in self.pieces if kind not in (BYTE, CONTROL, UNKNOWN)]
        return not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in text)

    def tokenizer(self, parts: bool):
        """The rebuilt backend; ``parts``: for parts of normalised texts, without the whole-text steps of the normaliser."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE(
                vocab={p: i for i, (p, _, _) in enumerate(self.pieces)},
                merges=self.merges(),
                unk_token=self.pieces[self.unk_id][0],
                fuse_unk=True,
                byte_fallback=self.byte_fallback,
                cache_capacity=0,
            )
        else:
            raise ValueError(f"model kind {self.kind} has no backend; use a unigram or BPE model")
        tok = Tokenizer(model)
        steps = []
        if not parts:
            if self.charsmap:
                steps.append(normalizers.Precompiled(self.charsmap))
            if self.squeeze_blanks:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            if self.dummy_prefix:
                steps.append(normalizers.Prepend(" "))
            if self.escape_blanks:
                steps.append(normalizers.Replace(" ", MARK))
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        tok.decoder = decoders.Sequence(after + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return tok


_PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    """Encoder and decoder of one worker, with the cache of parts; pass ``check=False`` to leave the parity check out."""

    def __init__(self, raw: bytes, check: bool = True):
        self.model = PieceModel.parse(raw)
        self.whole = self.model.tokenizer(parts=False)
        self.by_part = self.model.splits_at_words() and not self.model.charsmap and not self.model.squeeze_blanks and self.model.escape_blanks
        self.backend = self.model.tokenizer(parts=True) if self.by_part else self.whole
        self.peer = None
        if check:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.cache: dict[str, bytes] = {"": b""}  # packed ids
        self.differing: set[str] = set()
        self.line_end = np.array(self.backend.encode("\n", add_special_tokens=False).ids, dtype=np.int32) if self.by_part else None
        self.by_part = self.by_part and len(self.line_end) == 1 and self.line_end[0] != self.model.unk_id
        self.backend = self.backend if self.by_part else self.whole
        self.lead = len(self.peer.encode("\n")) if self.peer is not None else 0  # the dummy prefix, if any, and one line end
        kinds = np.array([k for _, _, k in self.model.pieces])
        self.is_byte = kinds == BYTE
        self.bytes = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, k in self.model.pieces
        ]

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text if self.model.dummy_prefix else text
        if "  " not in text and "\0" not in text and MARK not in text:  # the usual case without a pattern
            return text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0").split("\0")
        return _PARTS.findall(text.replace(" ", MARK))

    def learn(self, parts: list[str]) -> None:
        """Encode parts that the cache lacks, in multithreaded batches of lines, and compare with the SentencePiece library."""
        if "\n" in parts:
            parts.remove("\n")
            self.cache["\n"] = self.line_end.tobytes()
        lines = [parts[k : k + BATCH_PARTS] for k in range(0, len(parts), BATCH_PARTS)]
        for k in range(0, len(lines), BATCH_TEXTS):
            texts = ["\n".join(x) for x in lines[k : k + BATCH_TEXTS]]
            for new, e in zip(lines[k : k + BATCH_TEXTS], self.backend.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.int32)
                cuts = np.concatenate([[-1], np.flatnonzero(ids == self.line_end[0]), [len(ids)]])
                packed = [ids[a + 1 : b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                if self.peer is not None:
                    both = self._peer_ids(new)
                    if not np.array_equal(both, ids):
                        for j, part in enumerate(new):
                            one = self._peer_ids([part]).tobytes()
                            if one != packed[j]:
                                self.differing.add(part)
                                packed[j] = one
                self.cache.update(zip(new, packed, strict=True))

    def _peer_ids(self, parts: list[str]) -> np.ndarray:
        """What the SentencePiece library gives for parts on lines of their own, after a first line end."""
        got = self.peer.encode("\n" + "\n".join(parts).replace(MARK, " "))
        return np.array(got[self.lead :], dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text; whether all of it was encoded alike by both libraries."""
        if not self.by_part:
            got = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            if self.peer is None:
                return [np.array(i, np.int32) for i in got], [True] * len(texts)
            want = self.peer.encode(texts)
            return [np.array(i, np.int32) for i in want], [a == b for a, b in zip(got, want, strict=True)]
        split = [self.parts(t) for t in texts]
        missing = set(chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_PARTS:
            self.forget()
            missing = set(chain.from_iterable(split)) - {""}
        self.learn(list(missing))
        ids = [np.frombuffer(b"".join(map(self.cache.__getitem__, parts)), dtype=np.int32) for parts in split]
        return ids, [not self.differing or self.differing.isdisjoint(parts) for parts in split]

    def forget(self) -> None:
        """Give the memory of the parts back at the end of a task; workers live on for others."""
        self.cache = {"": b""}
        self.differing.clear()

    def decode(self, ids) -> str:
        """The text of the ids; invalid byte sequences become U+FFFD, as in the library's byte fallback."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[tuple[str, bool], Codec] = {}


def _codec(name: str, check: bool) -> Codec:
    """The worker's codec, built once from the model file that Spark has sent to the executor."""
    if (name, check) not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(SparkFiles.get(name), "rb") as f:
            _CODECS[name, check] = Codec(f.read(), check)
    return _CODECS[name, check]


_SENT: set[tuple[str, str]] = set()


def send_model(spark: SparkSession, model_path: str) -> str:
    """Give the model file (bounded: a vocabulary) to every executor once; its name there."""
    small_batches(spark)
    key = (spark.sparkContext.applicationId, model_path)
    if key not in _SENT:
        spark.sparkContext.addFile(model_path)
        _SENT.add(key)
    return os.path.basename(model_path)


def encode_column(spark: SparkSession, text: Column, model_path: str = DEFAULT_MODEL, check: bool = True) -> Column:
    """struct(ids array<int>, parity boolean) of each text."""
    name = send_model(spark, model_path)

    @F.pandas_udf("ids array<int>, parity boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(name, check)
        for batch in batches:
            ids, same = [], []
            for chunk in text_chunks([t if t is not None else "" for t in batch.tolist()]):
                a, b = codec.encode(chunk)
                ids += a
                same += b
            ids = [None if t is None else i for t, i in zip(batch.tolist(), ids, strict=True)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "parity": same})
        codec.forget()

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, model_path: str = DEFAULT_MODEL) -> Column:
    """The text of each list of ids."""
    name = send_model(spark, model_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(name, True)
        for batch in batches:
            yield pd.Series([None if i is None else codec.decode(i) for i in batch.tolist()], dtype=object)

    return decode(ids)


def token_report(spark: SparkSession, docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One row per document: counts and digest of its ids, parity with SentencePiece, whether decoding gives the text back.

    Encoding, digest and decoding run in one pass, so the ids themselves never leave the worker.
    """
    name = send_model(spark, model_path)

    @F.pandas_udf("n_tokens long, n_byte_tokens long, ids_sha256 string, parity boolean, round_trip boolean")
    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(name, True)
        for batch in batches:
            rows = []
            for chunk in text_chunks([t or "" for t in batch.tolist()]):
                for text, ids, same in zip(chunk, *codec.encode(chunk), strict=True):
                    digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                    rows.append((len(ids), int(codec.is_byte[ids].sum()), digest, same, codec.decode(ids) == text))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_byte_tokens", "ids_sha256", "parity", "round_trip"])
        codec.forget()

    return docs.select("doc_id", report(F.col("text")).alias("r")).select("doc_id", "r.*")


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All rows and columns of ``docs`` with ``token_ids``, ``n_tokens`` and ``token_parity`` (columns of these names are replaced)."""
    mark = "__spm_codes"
    coded = docs.withColumn(mark, encode_column(spark, F.col("text"), model_path))
    coded = coded.withColumns(
        {
            "token_ids": F.col(mark)["ids"],
            "n_tokens": F.when(F.col("text").isNotNull(), F.size(F.col(mark)["ids"])).cast("long"),
            "token_parity": F.col(mark)["parity"],
        }
    )
    return coded.drop(mark)
