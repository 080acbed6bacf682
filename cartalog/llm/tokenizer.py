"""Encoding of a whole corpus with a public byte-level vocabulary.

A sentencepiece BPE model is serialised directly from the vocabulary, nothing is trained: each entry's bytes, mapped to one printable
character each, are a piece; its score is its negated rank, so merges happen in the order of ranks; normalisation is the identity. Texts
are split into pre-tokens by the vocabulary's pattern, pre-tokens encoded as pieces, ids are ranks. Decoding maps the characters back to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits texts before the merges of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at most before it forgets them all.
REMEMBERED = 500_000


@cache
def byte_characters() -> tuple[str, ...]:
    """A printable character for each byte, none of them blank: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return tuple(chr(b) if b in own else chr(next(others)) for b in range(256))


def read_ranks(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> list[bytes]:
    """The vocabulary's entries in the order of their ranks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    entries = {int(rank): base64.b64decode(text) for text, rank in pairs}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError("ranks must be whole numbers from 0 on")
    return [entries[k] for k in range(len(entries))]


def model_bytes(entries: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the piece for the unknown, which bytes never need, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    letters, model = byte_characters(), proto.ModelProto()
    for rank, entry in enumerate(entries):
        model.pieces.add(piece="".join(letters[b] for b in entry), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(entries)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.letters = {b: ord(ch) for b, ch in enumerate(byte_characters())}
        self.known: dict[str, np.ndarray] = {}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; an empty and a null text have none."""
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list({w for words in split for w in words})
            pieces = [w.encode().decode("latin-1").translate(self.letters) for w in new]
            self.known.update((w, np.asarray(ids, dtype=np.int32)) for w, ids in zip(new, self.processor.encode(pieces, num_threads=1), strict=True))
        none = np.empty(0, dtype=np.int32)
        return [np.concatenate([self.known[w] for w in words]) if words else none for words in split]


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def spread(df: DataFrame) -> DataFrame:
    """df in at least two partitions per core, as work per row is heavy and few files may hold all rows."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def token_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids): ids of each row's text, without special tokens; their strings in a text are ordinary text.

    Empty and null texts have an empty list; rows stay rows, repeated or not; texts may be of any length; an empty table gives an empty
    one. Other columns play no part.
    """
    sent = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(name, folder)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), type=pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "ids"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(ids: list[int], entries: list[bytes]) -> str:
    """The text of ids."""
    return b"".join(entries[k] for k in ids).decode("utf-8", errors="replace")
