"""SentencePiece BPE through a table of distinct chunks.

The library turns every space into the marker U+2581 and puts one in front of
the text.  When no piece of the model has a marker after another character, no
merge crosses the place before a marker, so a text falls into chunks, each a
run of markers and what follows it, that are segmented on their own.  Every
distinct chunk is segmented once per task and its ids are joined back by the
chunk's positions; a task's table is emptied when it holds ``TABLE_BYTES``.
The table is not one of the whole corpus: joining every word of every document
with it by a shuffle would move several times the input, and its size grows
with the corpus, so that it could not be broadcast either.

Decoding inverts the mapping: the library decodes each distinct chunk once,
and the results are joined by position.

A model that needs a normaliser, treats white space as a suffix, drops extra
white space or has a piece across a marker is refused (``ValueError``).

Defined results: null counts as the empty text, whose only id is the end id;
texts of any length are encoded whole; an empty table gives no rows; repeated
rows are encoded alike; ties between merges are the library's own (the
leftmost first); only the named id and text columns are read, so further
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import map_texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_BYTES = 96 << 20      # estimated size at which a worker's table is emptied
ENTRY_BYTES = 500           # of an entry beside its text

_WORKER: dict = {}          # one table per Python worker, kept between its tasks


def read_model(path: str) -> bytes:
    """The serialised model of a file on the driver."""
    with open(path, "rb") as f:
        return f.read()


def checked(proto: bytes) -> bytes:
    """The model, if chunks can be segmented on their own."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto.FromString(proto)
    n, t = m.normalizer_spec, m.trainer_spec
    if n.name != "identity" or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix:
        raise ValueError("the model normalises texts, so chunks cannot be cut beforehand")
    if t.model_type != pb.TrainerSpec.BPE or t.treat_whitespace_as_suffix:
        raise ValueError("not a BPE model with white-space markers in front")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces):
        raise ValueError("a piece may cross a white-space marker")
    return proto


def chunks(text: str) -> list[str]:
    """The chunks of a text without their first marker: between single spaces
    as they are, else cut before every run of markers."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " ":
        return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Table:
    """The distinct chunks seen so far: their ids, the ids as decimal text,
    and the text they decode to in front of others and at a text's start."""

    def __init__(self, proto: bytes, limit: int = TABLE_BYTES):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.end, self.limit = self.sp.eos_id(), limit
        # The same pieces without the marker put before a text.
        from sentencepiece import sentencepiece_model_pb2 as pb
        bare = pb.ModelProto.FromString(proto)
        bare.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[str, np.ndarray] = {}
        self.decimal: dict[str, str] = {}
        self.inner: dict[str, str] = {}
        self.first: dict[str, str] = {}
        self.size = 0

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the chunks that the table lacks, each once."""
        if self.size > self.limit:
            self._empty()
        new = set()
        for cut in texts:
            new.update(cut)
        new = list(new.difference(self.ids))
        if new:
            found = self.bare.encode([MARK + c for c in new], num_threads=1)
            back = self.bare.decode(found, num_threads=1)
            for c, ids, text in zip(new, found, back):
                self.ids[c] = np.array(ids, np.int32)
                self.decimal[c] = " ".join(map(str, ids))
                self.inner[c] = text
                self.size += ENTRY_BYTES + 16 * len(c)

    def start(self, chunk: str) -> str:
        """What a text's first chunk decodes to."""
        if chunk not in self.first:
            self.first[chunk] = self.sp.decode(self.ids[chunk].tolist())
        return self.first[chunk]

    def decoded(self, cut: list[str]) -> str:
        if not cut:
            return ""
        return self.start(cut[0]) + "".join(map(self.inner.__getitem__, cut[1:]))


def _table(proto: bytes) -> Table:
    key = hashlib.sha256(proto).digest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Table(proto)
    return _WORKER[key]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))


def encode(docs: DataFrame, proto: bytes, doc_id: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """Per document: id and the array of ids, with the end id unless not wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(checked(proto))

    def make():
        table = _table(shared.value)

        def work(texts):
            cut = [chunks(t) for t in texts]
            table.learn(cut)
            tail = [np.array([table.end] if end else [], np.int32)]
            return [[np.concatenate([*map(table.ids.__getitem__, c), *tail]) for c in cut]]
        return work

    return map_texts(_rows(docs, doc_id, text), make, "ids array<int>")


def decode(encoded: DataFrame, proto: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: id and the text that the library decodes an array of ids to
    (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(proto)

    def make():
        sp = _table(shared.value).sp
        return lambda lists: [sp.decode([x.tolist() if hasattr(x, "tolist") else x for x in lists], num_threads=1)]

    rows = encoded.select(encoded[doc_id].alias("doc_id"), F.coalesce(encoded[ids], F.array()).cast("array<int>").alias("ids"))
    return map_texts(rows, make, "text string", text="ids")


def round_trip(docs: DataFrame, proto: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, number of ids, digest of the decimal ids, and digest
    of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(checked(proto))

    def make():
        table = _table(shared.value)
        end = str(table.end)

        def work(texts):
            cut = [chunks(t) for t in texts]
            table.learn(cut)
            out = [[], [], []]
            for c in cut:
                ids = " ".join([*map(table.decimal.__getitem__, c), end])
                out[0].append(ids.count(" ") + 1)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(hashlib.sha256(table.decoded(c).encode()).hexdigest())
            return out
        return work

    return map_texts(_rows(docs, doc_id, text), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
