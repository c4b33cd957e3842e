"""Byte-level BPE encoding and decoding with a sentencepiece model built from the vocabulary.

The rank file is turned straight into a sentencepiece BPE model: every byte becomes one private
character, a token's bytes become a piece scored by its negative rank, and normalisation is the
identity.  The model merges the best-scored adjacent pair first, which is the lowest rank first.
Each match of the split pattern is encoded separately; a match that is itself a token is taken
whole.  Decoding maps each id to its bytes and joins them.

Null and empty texts give an empty list of ids and empty bytes; repeated rows are repeated; other
columns stay as they are, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_CHARACTER = 0x100          # byte b is written as the character FIRST_CHARACTER + b
CACHED_TOKENS = 200_000          # distinct matches a task remembers before it starts again
MATCHES = 1 << 16                # matches of one text that are held at once


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in id order; ids must run from 0 without a gap."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


def mapped(token: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in token)


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; <unk> comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=mapped(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder(dict):
    """Remembers the ids of the matches it has met, packed as 32-bit integers."""

    def __init__(self, tokens: list[bytes], model: bytes):
        import sentencepiece

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {token: rank for rank, token in enumerate(tokens)}

    def __missing__(self, match: str) -> bytes:
        token = match.encode()
        rank = self.whole.get(token)
        ids = [rank] if rank is not None else self.processor.encode(mapped(token))
        packed = np.asarray(ids, dtype=np.int32).tobytes()
        if len(self) >= CACHED_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[match] = packed
        return packed


def packed_ids(encoder: Encoder, split, text: str | None) -> bytearray:
    """The ids of a text, packed as 32-bit integers; ``split`` is the compiled pattern."""
    packed, matches = bytearray(), split.finditer(text or "")
    while some := [m.group() for m in islice(matches, MATCHES)]:
        packed += b"".join(map(encoder.__getitem__, some))
    return packed


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids``: the token ids of ``text`` by the rank file ``ranks``."""
    tokens = read_ranks(ranks)
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, build_model(tokens)))  # one vocabulary

    def encoded(batches):
        import regex

        encoder, split = Encoder(*shipped.value), regex.compile(pattern)
        for column in batches:
            packed, ends = bytearray(), [0]           # one buffer, so that a batch is held once
            for value in column:
                packed += packed_ids(encoder, split, value.as_py())
                ends.append(len(packed) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(packed)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(ids, F.arrow_udf(encoded, "array<int>")(F.col(text)))


def decode(docs: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with a column ``decoded``: the bytes that the ids stand for (null ids: no bytes)."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def joined(batches):
        tokens = shipped.value
        for column in batches:
            ends = column.offsets.to_numpy() if column.null_count == 0 else None
            if ends is None:
                yield pa.array([b"".join(tokens[i] for i in x or ()) for x in column.to_pylist()], pa.binary())
                continue
            flat = column.values.to_numpy()
            yield pa.array(
                [b"".join([tokens[i] for i in flat[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
                pa.binary(),
            )

    joined.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(decoded, F.arrow_udf(joined, "binary")(F.col(ids)))


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: token count and the hashes of its ids and of the bytes they decode to.

    One worker encodes and decodes a text before it takes the next, so ids and bytes are held for one text.
    """
    tokens = read_ranks(ranks)
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, build_model(tokens)))
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digested(batches):
        import regex

        encoder, split, of = Encoder(*shipped.value), regex.compile(pattern), shipped.value[0]
        for column in batches:
            out = []
            for value in column:
                ids = np.frombuffer(packed_ids(encoder, split, value.as_py()), np.int32).tolist()
                told, decoded = ",".join(map(str, ids)).encode(), b"".join(map(of.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            counts, told, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], fields=list(kind)
            )

    digested.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    returns = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    return docs.select("doc_id", F.arrow_udf(digested, returns)(F.col("text")).alias("told")).select("doc_id", "told.*")
