"""Sum-of-squares packing of documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_arrow, text_of
from .tokens import byte_bpe

SEQUENCE = 1024
END_ID = 2
#: documents a packing group holds on average; the number of groups grows with the input
GROUP_DOCS = 60_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given.

    Each item goes where the sum over all gaps g of N(g)**2 becomes smallest, N(g)
    counting the open bins with g free places; a new bin is opened only when
    that is strictly better.  Of equal choices the tightest gap wins.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        change = 2 * (count[:capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]             # a bin filled up leaves the count
        change[here == 0] = far
        j = int(change.argmin())
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if change[j] <= fresh:
            gap = s + j
            count[gap] -= 1
            b = open_bins[gap].pop()
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def piece_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per input row: ``id, th, n`` and ``pieces`` (array of piece, start, length, ids_crc32[, ids]).

    A document is its token ids and ``end_id``; only one longer than ``sequence``
    is cut, into full pieces after a first piece that takes the remainder.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    spark_fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        spark_fields += ",ids:array<int>"
    end = end_id.to_bytes(4, "little")
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ns, pieces = [], []
                for ids in bpe.encode(part.column(2).to_pylist()):
                    raw = ids + end
                    n = len(raw) // 4
                    ns.append(n)
                    edges = [0, *range(n % sequence or min(n, sequence), n + 1, sequence)]
                    own = []
                    for k, (x, y) in enumerate(zip(edges, edges[1:])):
                        piece = {"piece": k, "start": x, "length": y - x, "ids_crc32": zlib.crc32(raw[4 * x:4 * y])}
                        if with_ids:
                            piece["ids"] = np.frombuffer(raw[4 * x:4 * y], "<u4").astype(np.int32)
                        own.append(piece)
                    pieces.append(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ns, pa.int64()),
                                                  pa.array(pieces, kind)], names=["id", "th", "n", "pieces"])

    return map_arrow(src, run, f"id {id_type}, th long, n long, pieces array<struct<{spark_fields}>>")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Documents are dealt by a hash of id and text to groups of about
    ``group_docs``; each group is packed on its own, longest first, by
    ``sum_of_squares``, and only lengths travel.  Groups grow in number with the
    input, never in size, and hold no key, so a hot source or text cannot make one
    large (rows alike in id and text are dealt one by one).  A full piece is a
    sequence by itself.  A sequence number is the group's and the bin's, joined.

    Null and empty texts are the end id alone; null and repeated ids are packed
    row by row.  An empty table gives an empty result.
    """
    table = cut(piece_table(docs, id_col, text_col, vocabulary, sequence, end_id, with_ids))
    groups = max(1, -(-table.count() // group_docs))
    # equal rows are one row with a count: the salt k deals them out
    lengths = (table.groupBy("id", "th", "n").agg(F.count("*").alias("m"))
               .select("id", "th", "n", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k")))
    salted = lengths.withColumn("g", F.pmod(F.xxhash64("id", "th", "k"), F.lit(groups)).cast("long"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "th", "k"], kind="stable").reset_index(drop=True)
        n = rows["n"].to_numpy()
        head = np.where(n % sequence > 0, n % sequence, sequence)
        full = (n - head) // sequence
        order = np.argsort(-head, kind="stable")
        bins, offsets = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        bins[order], offsets[order] = sum_of_squares(head[order], sequence)
        after = int(bins.max()) + 1 + np.concatenate(([0], np.cumsum(full)[:-1]))
        base = np.int64(key[0]) << np.int64(36)
        return pd.DataFrame({"id": rows["id"], "th": rows["th"], "k": rows["k"], "head_bin": base + bins,
                             "head_offset": offsets, "next_bin": base + after})

    id_type = docs.schema[id_col].dataType.simpleString()
    placed = cut(salted.groupBy("g").applyInPandas(
        pack, f"id {id_type}, th long, k long, head_bin long, head_offset long, next_bin long"))
    # the k-th of equal rows takes the k-th place
    one = table.groupBy("id", "th", "n").agg(F.first("pieces").alias("pieces")) if with_ids else \
        table.groupBy("id", "th", "n").agg(F.max("pieces").alias("pieces"))
    one = one.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "pieces")
    rows = placed.join(one, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    out = rows.select("id", "head_bin", "head_offset", "next_bin", F.explode("pieces").alias("p"))
    first = F.col("p.piece") == 0
    return out.select("id", "p.*", F.when(first, F.col("head_bin")).otherwise(
        F.col("next_bin") + F.col("p.piece") - 1).alias("sequence_id"),
        F.when(first, F.col("head_offset")).otherwise(F.lit(0).cast("long")).alias("offset"))
