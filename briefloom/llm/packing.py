"""Packing documents into fixed sequences along a space-filling curve.

Each document becomes a vector: its token ids, hashed to signs, averaged into a few dimensions. Standardised by the
corpus's mean and spread, the vector gives a Hilbert key; documents are range-sorted by the key, laid end to end along the
curve and cut every ``LENGTH`` tokens, so a sequence holds neighbours. What is left at the end is cut into
powers of two, which need no padding.

Null texts count as empty: such a document is its end mark alone. Ties of the key are ordered by id; repeated rows are
documents of their own. Empty input gives no rows. Tokens are made once and written, compressed, to the shared folder;
later steps move keys and lengths, and each document's tokens once, to its place. Tasks hold one batch of documents.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import stored, text_of

#: Tokens of a sequence; the id put after each document; dimensions and bits per dimension of the curve.
LENGTH = 1024
END_ID = 0
DIMS, BITS = 4, 10
SEED = 29


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Ranks of the byte-level BPE vocabulary; ``byte_bpe_50k.json`` is the same vocabulary and gives the same ids, more slowly."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary. The end-of-text mark in a text is its special token.

    The rank file is much the faster reader, but its pattern cannot step back over a very long run of blanks at the end of a
    text. Such texts are encoded by the ``.json`` file of the same vocabulary beside it, which gives the same ids.
    """

    def __init__(self, path: str, end_of_text: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = len(ranks) + 1
        self.type = "<u2" if self.size <= 1 << 16 else "<u4"
        self.plain, self.plain_path = None, os.path.splitext(path)[0] + ".json"
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end_of_text: len(ranks)})

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.bpe.encode_to_numpy(text, allowed_special="all").astype(self.type)
        except ValueError:
            if self.plain is None:
                from tokenizers import Tokenizer
                self.plain = Tokenizer.from_file(self.plain_path)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=self.type)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells, one row each, ``bits`` bits per dimension (transposed Gray-code form)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(dims):
            on = (x[i] & step) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(on, x[i], x[i] ^ swap)
        step >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, step = np.zeros_like(x[0]), 1 << (bits - 1)
    while step > 1:
        flip = np.where((x[-1] & step) > 0, flip ^ (step - 1), flip)
        step >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokenized(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Written rows ``id, row, n, v, blob``: token count with the end mark, hashed vector, compressed ids."""
    dims, seed = DIMS, SEED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), size=(encoder.size, dims))
        codec = pa.Codec("zstd")
        width = np.dtype(encoder.type).itemsize
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                counts, vectors, blobs = [], [], []
                for text in part["text"]:
                    ids = encoder.encode(text)
                    counts.append(len(ids) + 1)
                    total = sum((np.take(signs, ids[i:i + 65536], axis=0).sum(0, dtype=np.int64) for i in range(0, len(ids), 65536)), np.zeros(dims))
                    vectors.append((total / max(len(ids), 1)).tolist())
                    blobs.append(codec.compress(ids.tobytes(), asbytes=True))
                yield pd.DataFrame({"id": part["id"], "n": counts, "v": vectors, "blob": blobs, "width": width})

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(run, f"id {id_type}, n long, v array<double>, blob binary, width int")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "tokens")


def curve_positions(rows: DataFrame) -> DataFrame:
    """``(id, row, n, v)`` to ``(row, at)``: the number of tokens before each document along the curve."""
    stats = rows.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])
    bits = BITS

    @F.pandas_udf("long")
    def key(v: pd.Series) -> pd.Series:
        z = (np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1) - means) / spread
        cells = np.floor((1 + np.tanh(z / 1.6)) / 2 * (1 << bits)).clip(0, (1 << bits) - 1)
        return pd.Series(hilbert_keys(cells, bits))

    keyed = rows.select("id", "row", "n", key("v").alias("key"))
    ranged = keyed.repartitionByRange("key", "id", "row").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "curve")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition: as many as there are shuffle partitions
    return ranged.withColumn("in", inside).join(F.broadcast(parts), "part").select("row", (F.col("base") + F.col("in")).alias("at"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Every id lies in exactly one piece."""
    tokens = tokenized(docs, path or tokenizer_path(), text_col, id_col)
    places = stored(curve_positions(tokens.select("id", "row", "n", "v")), "places")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ends = [total // length * length]  # then the rest in powers of two
    for bit in reversed(range(length.bit_length())):
        if (total % length) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    edges = np.array(ends, dtype=np.int64)
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                raw = codec.decompress(r.blob, (r.n - 1) * r.width, asbytes=True) if r.n > 1 else b""
                ids = np.append(np.frombuffer(raw, dtype=f"<u{r.width}").astype("<u4"), np.uint32(END_ID))
                begin = 0
                while begin < r.n:
                    at = r.at + begin
                    if at < edges[0]:
                        seq, first = divmod(at, length)
                        room = length - first
                    else:
                        k = int(np.searchsorted(edges, at, side="right"))
                        seq, first, room = edges[0] // length + k - 1, at - edges[k - 1], edges[k] - at
                    take = int(min(room, r.n - begin))
                    out.append((r.id, begin, take, zlib.crc32(ids[begin:begin + take].tobytes()), r.n, int(seq), int(first)))
                    begin += take
            yield pd.DataFrame(out, columns=columns)

    id_type = docs.schema[id_col].dataType.simpleString()
    joined = tokens.select("id", "row", "n", "blob", "width").join(places, "row").select("id", "n", "blob", "width", "at")
    pieces = joined.mapInPandas(cut, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)
