"""Token counts through a digest cache.

A document's key in the cache is the SHA-256 of its content (a null text counts as empty; nothing else is normalised,
because any other change of the text could change its count) together with the digest of the tokenizer's file and
library version. Documents are joined with the stored counts; only distinct contents that the cache lacks are encoded,
and their counts are appended, as one committed Parquet write. A failed or repeated write can store a count twice, so
readers take one entry per digest.

Within a task, the texts to encode are cut into pieces where the tokenizer's own splitting has a boundary whatever stands
around it (``cut_starts``), and each distinct piece goes to the library once a batch at most; a text's count is the sum
over its pieces. Texts that hold an added token, batches whose pieces hardly repeat, and all texts of a tokenizer that
splits otherwise go there whole.

Defined cases: an empty table gives no rows and appends nothing; null and empty texts have no tokens; copies are encoded
once and counted for every row; repeated rows come out repeated; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import give_back, keep_rows, materialise, new_path, small_batches

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Characters given to the tokenizer at a time, which bounds what it holds.
SLICE_CHARS = 1_000_000
#: The same for pieces, for each of which it makes a result; how many counts of pieces a task keeps, and up to which length.
PIECE_SLICE_CHARS, KEPT_PIECES, KEPT_CHARS = 65_536, 1 << 19, 48
#: Where more than this share of a batch's pieces would go to the library, its texts go there whole, which costs less.
MOST_MISSES = 1 / 3


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's version: its file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


def loaded(path: str):
    """The tokenizer. It is loaded for a task and not kept, so that idle workers hold nothing."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def slices(texts: list[str], chars: int = SLICE_CHARS):
    """The texts in runs of about ``chars`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > chars:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def splits_at_cuts(tok) -> bool:
    """Whether the tokenizer splits by ByteLevel's expression alone, the one that ``CUTS`` is made for."""
    from tokenizers import models, pre_tokenizers

    split = tok.pre_tokenizer
    by_bytes = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
    return tok.normalizer is None and by_bytes and isinstance(tok.model, models.BPE) and not tok.model.dropout


def cut_table() -> np.ndarray:
    """By 256 * byte + next byte: 1 if ByteLevel's expression always begins a match between them, 2 if it does unless the
    first byte ends a white space character, else 0.

    The expression is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. No match goes on
    from another character to white space, or from one of letter, digit and sign to another, but for a contraction's
    apostrophe. It looks ahead only in white space and never behind, so both sides of a cut split as they do in the text.
    """
    blank, letter, digit = (np.isin(np.arange(256), list(c)) for c in (b" \t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
    high = np.arange(256) >= 128
    sign = (np.arange(256) > 32) & (np.arange(256) < 127) & ~letter & ~digit
    plain = sign & (np.arange(256) != ord("'"))
    pairs = [(letter | digit | sign, blank), (letter, digit | sign), (digit, letter | sign), (plain, letter), (sign, digit)]
    return (sum(np.outer(a, b) for a, b in pairs) > 0).astype(np.uint8).ravel() + 2 * np.outer(high, blank).astype(np.uint8).ravel()


CUTS = cut_table()
#: The last bytes of white space beyond ASCII, in UTF-8 two or three bytes long.
WIDE_BLANKS = [int.from_bytes(chr(c).encode(), "big") for c in range(128, 0x10000) if chr(c).isspace()]


def cut_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in ``data``, the UTF-8 of texts that start and end at ``offsets``; texts' starts are among them."""
    pair = data[:-1].astype(np.uint16) << 8
    pair |= data[1:]
    kind = CUTS[pair]
    at = np.flatnonzero(kind == 2)  # The byte at ``at`` ends a character of two bytes at least.
    last = [data[np.maximum(at - i, 0)].astype(np.int64) << 8 * i for i in range(3)]
    kind[at[np.isin(last[0] | last[1], WIDE_BLANKS) | np.isin(last[0] | last[1] | last[2], WIDE_BLANKS)]] = 0
    starts = np.zeros(len(data), bool)
    starts[1:] = kind
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(starts)


def encoded_lengths(tok, texts: list[str], chars: int = SLICE_CHARS) -> list[int]:
    return [len(e) for part in slices(texts, chars) for e in tok.encode_batch_fast(part, add_special_tokens=False)]


def counts_by_piece(tok, texts: pa.Array, kept: dict[str, int]) -> np.ndarray:
    """Token counts of texts without added tokens; ``kept`` holds counts of pieces from batch to batch."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts = cut_starts(data, offsets)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    found = [kept.get(p, -1) for p in distinct]
    misses = [i for i, n in enumerate(found) if n < 0]
    if len(misses) > MOST_MISSES * len(pieces):
        return np.array(encoded_lengths(tok, texts.to_pylist()), np.int64)
    for i, n in zip(misses, encoded_lengths(tok, [distinct[i] for i in misses], PIECE_SLICE_CHARS), strict=True):
        found[i] = n
        if len(kept) < KEPT_PIECES and len(distinct[i]) <= KEPT_CHARS:
            kept[distinct[i]] = n
    sums = np.append(0, np.cumsum(np.array(found, np.int64)[pieces.indices.to_numpy()]))
    return np.diff(sums[np.searchsorted(starts, offsets)])


def count_texts(tok, texts: pa.Array, kept: dict[str, int]) -> np.ndarray:
    """The library's token counts of texts (none null)."""
    whole = np.full(len(texts), not splits_at_cuts(tok))
    for added in tok.get_added_tokens_decoder().values():
        whole |= pc.match_substring(texts, added.content).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), np.int64)
    counts[whole] = encoded_lengths(tok, texts.filter(pa.array(whole)).to_pylist())
    counts[~whole] = counts_by_piece(tok, texts.filter(pa.array(~whole)) if whole.any() else texts, kept)
    return counts


def count_tokens(rows: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text), encoded in Arrow batches."""

    def run(batches):
        tok, kept = loaded(path), {}
        for b in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_texts(tok, b.column(1), kept), pa.int64())], names=["digest", "n_tokens"])
        del tok, kept
        give_back()

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts for a tokenizer version, one per digest; none if nothing was stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; the cache at ``cache`` gets what it lacked."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("doc_id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    members = materialise(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "token-members")
    known = read_cache(spark, cache, version)
    first = members.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    misses = first.join(known, "digest", "left_anti").select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))
    misses = materialise(misses, "token-misses")
    others = materialise(members.join(misses, ["digest", "row"], "left_anti").select("digest", "doc_id"), "token-others")
    # Rows that repeat a missing row's id and text share its key, and so they must not count as "other".
    twins = others.join(misses, others.digest.eqNullSafe(misses.digest) & others.doc_id.eqNullSafe(misses.doc_id), "left_semi")
    others = materialise(others.join(twins.distinct(), others.digest.eqNullSafe(twins.digest) & others.doc_id.eqNullSafe(twins.doc_id), "left_anti"), "token-rest") if not twins.isEmpty() else others
    todo = keep_rows(keyed, misses.drop("row"), others, {"doc_id": "doc_id", "digest": "digest"})
    counted = count_tokens(todo, path).withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").parquet(cache)
    # Written first, so that the join has two plain sides and a digest that many rows share can be split.
    counts = materialise(first.select("digest").join(read_cache(spark, cache, version), "digest"), "token-counts")
    return (
        members.join(counts, "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("content_digest"))
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so every distinct text is encoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
