"""SentencePiece encoding and decoding, exact for merge-ranked (BPE) vocabularies.

The scan over boundary states finds the segmentation of largest summed score.
The public SentencePiece vocabulary is of the BPE type: its ids come from merging
by rank, which no sum of piece scores reproduces (see README for the measured
difference).  So texts are split here where no merge can reach across, and the
parts are encoded on their own: the ids equal those of the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, text_of

#: A space after a character that is neither a space nor the mark standing for it.
#: No piece holds the mark after another character, so no merge spans this place.
_JOINT = re.compile("(?<=[^ ▁]) ")
CACHE_ENTRIES = 300_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.vocab_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this vocabulary spans a word start; texts cannot be split there")
        self.mark = self.model.piece_to_id("▁")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        parts = [_JOINT.split(t) for t in texts]
        new = list({p for doc in parts for p in doc if p not in known})
        for p, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            known[p] = np.array(ids, "<i4").tobytes()
        # the space at a joint is the mark that a part begins with by itself, unless the part is empty
        known[""] = np.array([self.mark], "<i4").tobytes()
        return [b"".join(map(known.__getitem__, doc)) if doc != [""] else b"" for doc in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


@cache
def codec(path: str | None) -> Codec:
    """The model at ``path``, or the named file of the installed public vocabularies."""
    import os
    if path is None or os.sep not in path:
        import public_tokenizers
        path = public_tokenizers.path(path or "piece_bpe_32k.model")
    return Codec(path)


def sentencepiece_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         model: str | None = None) -> DataFrame:
    """One row per input row: ``id, ids`` (array of int), equal to encoding the whole text at once.

    Null and empty texts have no ids; null and repeated document ids need no
    care, rows being independent.  Nothing is shuffled.  Distinct parts are
    encoded once per worker while they stay in a bounded cache, and texts of any
    length are encoded part by part.
    """
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = c.encode(part.column(1).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(src, run, f"id {id_type}, ids array<int>")


def sentencepiece_decode(coded: DataFrame, ids_col: str = "ids", text_col: str = "text",
                         model: str | None = None) -> DataFrame:
    """``coded`` with ``text_col`` decoded from ``ids_col`` (null ids: null text), other columns as they are.

    The mark U+2581 in a text is indistinguishable from a space, as in the library itself.
    """
    rest = coded.drop(text_col)
    names = [*rest.columns, text_col]
    at = names.index(ids_col)
    schema = rest.withColumn(text_col, F.lit("").cast("string")).schema
    schema[text_col].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for x in range(0, b.num_rows, 512):
                part = b.slice(x, 512)
                lists = part.column(at).to_pylist()
                texts = iter(c.decode([i for i in lists if i is not None]))
                out = pa.array([None if i is None else next(texts) for i in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=names)

    return map_arrow(rest, run, schema)


def codec_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: number of ids, crc32 of the ids (unsigned 32-bit), and the hash of the decoded text."""
    back = sentencepiece_decode(sentencepiece_encode(docs, model=model), model=model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in lists]
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(crc, pa.int64()), b.column(2)],
                                             names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(back.select("id", "ids", F.sha2("text", 256).alias("decoded_sha256")), run,
                     f"doc_id {id_type}, n_ids long, ids_crc32 long, decoded_sha256 string")
