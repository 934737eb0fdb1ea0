"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary becomes a sentencepiece BPE model: every byte string is written
with one printable character per byte, its score is its negative rank, and
normalisation is the identity.  Sentencepiece merges the best-scored pair
first, which is the order of the ranks.  Texts are cut by the public pattern,
each pre-token is encoded on its own, and decoding inverts the mapping.

Defined results: null counts as the empty text, which has no ids; any text,
however long, is encoded whole; repeated rows are encoded alike; only the
named id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame

from fieldlab.llm.common import map_texts
from fieldlab.llm.pretokens import Pieces

_WORKER: dict = {}       # one codec per Python worker, kept between its tasks


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable
    and no white space in Latin-1, else the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


CHARS = byte_characters()
BYTES = {ord(c): b for b, c in enumerate(CHARS)}
AS_CHARS = {b: c for b, c in enumerate(CHARS)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(AS_CHARS)


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [t for _, t in sorted((int(r), base64.b64decode(t)) for t, r in pairs)]


def model_proto(ranks: list[bytes]) -> bytes:
    """Serialised sentencepiece model; the piece of rank r has id r + 1."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(ranks) + 1
    m.trainer_spec.unk_id = 0
    m.trainer_spec.bos_id = m.trainer_spec.eos_id = m.trainer_spec.pad_id = -1
    m.trainer_spec.unk_piece = "⁇"      # no byte character, so no piece of the vocabulary
    n = m.normalizer_spec
    n.name = "identity"
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    m.pieces.add(piece="⁇", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for r, t in enumerate(ranks):
        m.pieces.add(piece=mapped(t), score=-float(r), type=pb.ModelProto.SentencePiece.NORMAL)
    return m.SerializeToString()


class Codec:
    """Encodes and decodes with a serialised model."""

    def __init__(self, proto: bytes, pattern: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.tokens = [self.sp.id_to_piece(i).translate(BYTES).encode("latin-1") if i else b""
                       for i in range(self.sp.get_piece_size())][1:]
        self.ids = {t: r for r, t in enumerate(self.tokens)}
        self.pieces = Pieces(pattern, self.encode_pretokens, lambda parts: [i for p in parts for i in p])

    def encode_pretokens(self, tokens: list[str]) -> list[list[int]]:
        """A pre-token that is in the vocabulary is one id; sentencepiece
        merges the others."""
        raw = [t.encode("utf-8") for t in tokens]
        out = [[self.ids[r]] if r in self.ids else None for r in raw]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, ids in zip(rest, self.sp.encode([mapped(raw[i]) for i in rest], num_threads=1)):
            out[i] = [x - 1 for x in ids]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for p in parts for i in p] for parts in self.pieces(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(proto: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(proto).digest(), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Codec(proto, pattern)
    return _WORKER[key]


def encode(docs: DataFrame, proto: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and the array of token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def make():
        c = codec(shared.value, pattern)
        return lambda texts: [c.encode(texts)]

    return map_texts(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), make, "ids array<int>")


def round_trip(docs: DataFrame, proto: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, number of tokens, digest of the decimal ids, digest
    of the bytes that decoding the ids gives back."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def make():
        c = codec(shared.value, pattern)
        names = list(map(str, range(len(c.tokens))))

        def work(texts):
            out = [[], [], []]
            for ids in c.encode(texts):
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            return out
        return work

    return map_texts(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), make,
                     "n_tokens long, ids_sha256 string, decoded_sha256 string")
