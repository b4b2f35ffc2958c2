"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks of ``chunk`` characters, each with ``overlap`` characters of its successor. Chunks are
pre-tokenised in parallel, and only the starts of the matches in a chunk's first and last ``overlap`` characters are
kept. The pattern has no look-behind, so once two neighbouring chunks have a match start in common, they agree from
there on: the first common start is where they are stitched. Pieces between stitches are encoded separately, ids are
concatenated in order, and decoding concatenates the ids' raw bytes. Where neighbours never resynchronise within the
overlap (a run of one class longer than the overlap), what follows in that text is encoded as one piece, so the ids are
always those of the whole text. Texts up to ``chunk + overlap`` characters are one piece and are encoded where they are.

Defined cases: an empty table gives no rows; a null or empty text has no ids, and decodes to no bytes; repeated rows
come out repeated; other columns of the input are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veraframe.llm.common import give_back, materialise, small_batches

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 4_096

def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file. It is loaded for a task and not kept, so that idle workers hold nothing."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_texts(rows: DataFrame, keys: list[str], text: str, path: str, pattern: str) -> DataFrame:
    """``keys``, n_tokens and ids (little-endian unsigned 32-bit) of every text, in Arrow batches."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in small_batches(batches, len(keys)):
            packed = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([len(i) // 4 for i in packed], pa.int64()), pa.array(packed, pa.binary())], names=[*keys, "n_tokens", "ids"])
        del enc
        give_back()

    picked = rows.select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, n_tokens long, ids binary")


def match_starts(chunks: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(row, i, head, tail): absolute match starts in the first ``overlap`` characters of a chunk and of its successor."""

    def run(batches):
        import regex

        compiled = regex.compile(pattern)
        for b in batches:
            head, tail = [], []
            for i, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                starts = [m.start() for m in compiled.finditer(text)]
                head.append([i * chunk + s for s in starts if s < overlap])
                tail.append([i * chunk + s for s in starts if s >= chunk])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["row", "i", "head", "tail"])

    return chunks.select("row", "i", "part").mapInArrow(run, "row long, i int, head array<long>, tail array<long>")


def stitched_pieces(long: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(row, doc_id, piece, text): texts cut where neighbouring chunks resynchronise. ``long`` has doc_id and text."""
    n = F.length("text")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap)))
    numbered = long.withColumn("row", F.monotonically_increasing_id())
    chunks = materialise(numbered.select("row", "doc_id", n.alias("n"), F.posexplode(parts).alias("i", "part")), "bpe-chunks")
    starts = materialise(match_starts(chunks.repartition("row", "i"), chunk, overlap, pattern), "bpe-starts")
    of_text = Window.partitionBy("row").orderBy("i")
    common = F.array_intersect(F.lag("tail").over(of_text), F.col("head"))
    cuts = starts.withColumn("common", common)
    cuts = cuts.withColumn("met", (F.col("i") == 0) | (F.size("common") > 0))
    cuts = cuts.withColumn("met", F.min(F.col("met").cast("int")).over(of_text) == 1)
    cuts = cuts.withColumn("cut", F.when(F.col("i") == 0, F.lit(0)).when(F.col("met"), F.array_min("common")))
    cuts = cuts.withColumn("next_cut", F.lead("cut").over(of_text)).withColumn("piece", F.max(F.when(F.col("met"), F.col("i"))).over(of_text))
    start = F.coalesce("cut", F.col("i").cast("long") * chunk)
    end = F.least(F.coalesce("next_cut", (F.col("i") + 1).cast("long") * chunk), F.col("n"))
    cut = F.substring(F.col("part"), (start - F.col("i") * chunk + 1).cast("int"), (end - start).cast("int"))
    segments = chunks.join(cuts.select("row", "i", "cut", "next_cut", "piece"), ["row", "i"]).select("row", "doc_id", "piece", F.struct("i", cut.alias("text")).alias("segment"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("segment")), lambda s: s.text), "")
    return segments.groupBy("row", "doc_id", "piece").agg(joined.alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = encode_texts(base.filter(~is_long), ["doc_id"], "text", path, pattern)
    pieces = stitched_pieces(base.filter(is_long), chunk, overlap, pattern)
    encoded = encode_texts(pieces, ["row", "doc_id", "piece"], "text", path, pattern)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("ids")))), lambda s: s.ids)
    long = encoded.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.unhex(F.array_join(in_order, "")).alias("ids"))
    return short.unionByName(long.drop("row"))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in place of the ids' column, and the ids' digest."""
    kept = [c for c in encoded.columns if c != ids]
    at = len(kept)

    def run(batches):
        enc = encoding(path, pattern)
        for b in small_batches(batches, at):
            raw = [enc.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(raw, pa.binary())], names=[*kept, out])
        del enc
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != ids)
    return encoded.select(*kept, ids).mapInArrow(run, f"{kinds}, `{out}` binary")


def round_trip_texts(rows: DataFrame, keys: list[str], text: str, path: str, pattern: str) -> DataFrame:
    """``keys``, n_tokens, ids and the bytes decoded from them, in one pass through a Python worker."""
    n = len(keys)

    def run(batches):
        enc = encoding(path, pattern)
        for b in small_batches(batches, n, 2_000_000):
            packed = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in b.column(n).to_pylist()]
            raw = [enc.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in packed]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([len(i) // 4 for i in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(raw, pa.binary())], names=[*keys, "n_tokens", "ids", "decoded"])
        del enc
        give_back()

    picked = rows.select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, the latter from the decoded ids.

    Pieces of a long text are decoded on their own; their ids and bytes are joined in order.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = round_trip_texts(base.filter(~is_long), ["doc_id"], "text", path, pattern)
    pieces = round_trip_texts(stitched_pieces(base.filter(is_long), chunk, overlap, pattern), ["row", "doc_id", "piece"], "text", path, pattern)
    in_order = lambda c: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex(c).alias("v")))), lambda s: s.v), ""))
    long = pieces.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), in_order("ids").alias("ids"), in_order("decoded").alias("decoded"))
    digests = ("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return short.select(*digests).unionByName(long.select(*digests))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
