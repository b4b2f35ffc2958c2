"""N-gram Jaccard join with rare-first prefix filtering.

Documents with one word sequence form a class; each class is shingled once. Sets are counted by 64-bit hashes of their
shingles, and candidates are found by 48 bits of these; what is reported as similar is compared by the words themselves.
The global order of shingles is rare first: by document frequency, then by hash. A class's prefix are its first ``n - ceil(t n) + 1``
shingles in that order; two classes with Jaccard similarity of at least ``t`` share a shingle of both prefixes. As only
about the first ``1 - t`` of a class's shingles can be in its prefix, a first pass needs frequencies only for a fixed
fraction of all shingles: those with hashes below ``FRACTION`` stand before all others in its order, and a class that has
too few of them brings all its shingles. It leaves the classes that share a prefix shingle with any other; most documents
of a corpus end there. The join itself then orders all shingles of these classes.

Frequencies: blocks of classes send their distinct hashes, packed, to hash buckets; a bucket adds up the frequencies and
answers each block with the hashes that occur more than once. A hash costs a block one entry, however many documents
hold it. Prefix shingles with frequency 1 meet nobody and are left out of the join.

Pairs: classes meet in the lists of their prefix shingles, under the length and the positional filter. A list is not
multiplied out. In a round, a list's most central members (fewest unique shingles) are paired with all its other members
that are not yet known to be in the same component, and then leave the list; the number of centres grows from round to
round. A list whose members are all in one component is done. A pair that several lists bring is looked at once, and
never again in later rounds. So a group of near copies costs about one pair a member, while every link between different
components is found. The suffix filter looks at what stands after a shared prefix shingle in the global order: every entry
of a list carries the counts of its suffix's hashes in 32 ranges, their differences bound the Hamming distance of the two
suffixes from below, and so the overlap from above. What is left is verified on the shingles themselves.

Defined cases: an empty table gives no rows; null texts and texts without words have empty sets and are linked with
nothing; with fewer than ``k`` words the whole sequence is the one shingle; copies share a class; rows that repeat come
out repeated; a null id is largest; other columns pass through :func:`drop_near_copies` and are otherwise ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import BLANK_CLASS, fresh, keep_rows, materialise, same, small_batches, told_apart
from veraframe.operators.graph import components

FRACTION = 0.3
BLOCK_HASHES = 1_000_000
BUCKET_HASHES = 2_000_000
SUFFIX_WORDS = 4  # of eight one-byte counts: the ranges of the suffix filter
CENTRES = 8  # times as many a list from round to round

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_sequence(text: str) -> Column:
    """Words in lower case (A-Z only), with one blank between them; null as empty."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lower, BLANK_CLASS + "+", " "))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's ``k``-word shingles; words are parted by single blanks."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = 1 + np.concatenate(([0], np.cumsum(sizes)[:-1])) if texts else np.zeros(0, np.int64)
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    solid = buf != 32
    at = np.flatnonzero(solid)
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(texts)
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    lengths = ends - starts
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    np.multiply.accumulate(powers, out=powers)
    first = np.cumsum(lengths) - lengths
    terms = (buf[at].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(first, lengths)]
    words = _mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    owner = np.searchsorted(begins, starts, "right") - 1
    out = [np.zeros(0, np.uint64)] * len(texts)
    factors = np.full(k, 0xD1342543DE82EF95, np.uint64)
    np.multiply.accumulate(factors, out=factors)
    full = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * factors[j]
    full = _mix(full)
    present, word_at, counts = np.unique(owner, return_index=True, return_counts=True)
    for d, w, n in zip(present, word_at, counts, strict=True):
        if n >= k:
            out[d] = np.unique(full[w : w + n - k + 1])
        else:
            out[d] = _mix((words[w : w + n] * factors[:n]).sum(keepdims=True) + np.uint64(n))
    return out


def pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sketch_classes(texts: DataFrame, k: int, num: int, den: int, limit: int, keep_words: bool = False) -> DataFrame:
    """Written table of classes: c, doc_id, digest, block, n and brought (packed hashes); ``texts`` has doc_id, digest, words.

    A class brings its hashes below ``limit``, or all if those might not hold its prefix.
    """

    def run(batches):
        task, block, held = TaskContext.get().partitionId() << 24, 0, 0
        for b in small_batches(batches, 2, 2_000_000):
            ns, brought, blocks = [], [], []
            for h in shingle_sets([t.encode() for t in b.column(2).to_pylist()], k):
                short = np.unique(h >> np.uint64(16))
                low = short[: np.searchsorted(short, np.uint64(limit))]
                some = low if len(low) >= 1.25 * prefix_length(len(h), num, den) + 2 else short
                if held > BLOCK_HASHES:
                    block, held = block + 1, 0
                held += len(some)
                ns.append(len(h)), brought.append(pack(some)), blocks.append(task + block)
            columns = [b.column(0), b.column(1), pa.array(blocks, pa.int64()), pa.array(ns, pa.int64()), pa.array(brought, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [b.column(2)] * keep_words, names=["doc_id", "digest", "block", "n", "brought"] + ["words"] * keep_words)

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "digest", "words").mapInArrow(run, f"doc_id {kind}, digest binary, block long, n long, brought binary" + ", words string" * keep_words)
    return materialise(rows.withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")


def shared_hashes(classes: DataFrame) -> DataFrame:
    """(block, hashes, df): for every block its hashes that occur in two classes or more, packed, and their frequencies."""
    total = classes.agg(F.sum(F.octet_length("brought") / 6)).first()[0] or 0
    buckets = max(8, int(total // BUCKET_HASHES) + 1)

    def ask(batches):
        def flush(block, parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, n, bucket = h[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [(int(bucket[lo]), block, pack(h[lo:hi]), n[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(cuts, [*cuts[1:], len(h)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "hashes", "counts"])

        now, parts, held = None, [], 0
        for b in small_batches(batches, 1):
            for block, brought in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (block != now or held > 2 * BLOCK_HASHES):
                    yield flush(now, parts)
                    parts, held = [], 0
                now = block
                if brought:
                    parts.append(unpack(brought))
                    held += len(brought) // 6
        if held:
            yield flush(now, parts)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(x) for x in pdf["hashes"]]
        found, where = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(where, np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]])).astype(np.int64)
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        out = [(b, h, n) for b, h, n in zip(pdf["block"], hashes, np.split(df[where], cut), strict=True)]
        out = [(b, pack(h[n > 1]), n[n > 1].astype("<u4").tobytes()) for b, h, n in out if (n > 1).any()]
        return pd.DataFrame(out, columns=["block", "hashes", "df"])

    asked = classes.select("block", "brought").mapInArrow(ask, "bucket int, block long, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block long, hashes binary, df binary")


def suffix_counts(ranges: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each position in ``upto``, how many later entries of ``ranges`` are in each range, at most 255: packed numbers."""
    width = 8 * SUFFIX_WORDS
    one = np.zeros((int(upto.max()) + 1, width), np.int32)
    one[np.arange(len(one)), ranges[: len(one)]] = 1
    after = np.bincount(ranges, minlength=width) - np.cumsum(one, axis=0)[upto]
    return np.minimum(after, 255).astype(np.uint8).view("<i8")


def suffix_distance(a: list[str], b: list[str]) -> Column:
    """A lower bound of the Hamming distance of two suffixes, from their packed counts."""
    count = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(255)
    return functools.reduce(lambda x, y: x + y, [F.abs(count(x, i) - count(y, i)) for x, y in zip(a, b, strict=True) for i in range(8)])


SUFFIX = [f"s{i}" for i in range(SUFFIX_WORDS)]


def prefix_lists(classes: DataFrame, num: int, den: int, limit: int, suffixes: bool = False) -> DataFrame:
    """Written table of prefix shingles that two classes or more have in their prefixes: h, c, n, pos and alone.

    ``alone`` is the number of a class's brought shingles that no other class has; they stand first in its order. A
    class with more of them than similarity allows can't link and is left out. With ``suffixes``, for classes that bring
    all their hashes, there are also the counts of what follows in a class's order.
    """

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(right):
            known = np.concatenate([unpack(x) for x in right["hashes"]])
            df = np.concatenate([np.frombuffer(x, "<u4") for x in right["df"]])
            known, at = np.unique(known, return_index=True)
            df = df[at]
            for c, n, brought in zip(left["c"], left["n"], left["brought"], strict=True):
                h = unpack(brought)
                if not len(h):
                    continue
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                met = known[i] == h
                freq = np.where(met, df[i], 1)
                in_order = np.lexsort((h, freq, h >= limit))
                pos = np.empty(len(h), np.int64)
                pos[in_order] = np.arange(len(h))
                keep = met & (pos < prefix_length(n, num, den))
                alone = int((~met & (h < limit)).sum())  # others' shingles beyond it may not be known
                if keep.any() and alone < prefix_length(n, num, den):
                    after = suffix_counts((h[in_order] >> np.uint64(43)).astype(np.int64), pos[keep]).T if suffixes else ()
                    parts.append((h[keep].astype(np.int64), np.full(keep.sum(), c), np.full(keep.sum(), n), pos[keep], np.full(keep.sum(), alone), *after))
        names = ["h", "c", "n", "pos", "alone"] + SUFFIX * suffixes
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * len(names)
        return pd.DataFrame(dict(zip(names, cols, strict=True)))

    left = classes.select("block", "c", "n", "brought").groupBy("block")
    schema = "h long, c long, n long, pos long, alone long" + "".join(f", {x} long" for x in SUFFIX * suffixes)
    rows = materialise(left.cogroup(shared_hashes(classes).groupBy("block")).applyInPandas(order, schema), "jaccard-lists")
    single = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m = 1").select("h")
    single = materialise(single, "jaccard-single")  # written, so that the join has plain exchanges that can be split
    return materialise(rows.join(single, "h", "left_anti"), "jaccard-met")


def word_shingles(words: str, k: int) -> set[tuple[str, ...]]:
    w = words.split(" ")
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)}


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) with Jaccard similarity of at least num / den, by the shingles themselves; ``texts`` has c and words."""

    def run(batches):
        for b in small_batches(batches, 2, 2_000_000):
            keep, last, x = [], None, set()
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if left != last:
                    last, x = left, word_shingles(left, k)
                y = word_shingles(right, k)
                both = len(x & y)
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: texts.select(F.col("c").alias(x), F.col("words").alias(f"words_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def class_components(classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(c, comp) of the classes that share a prefix shingle; ``classes`` bring all their hashes and their words."""
    lists = prefix_lists(classes, num, den, 2**48, suffixes=True)
    spark = classes.sparkSession
    labels = materialise(lists.select("c").distinct().withColumn("comp", F.col("c")), "jaccard-labels")
    seen, centres_a_list = spark.createDataFrame([], "a long, b long"), 1
    while True:
        active = materialise(lists.join(labels, "c"), "jaccard-active")
        live = active.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h")
        active = materialise(active.join(materialise(live, "jaccard-live"), "h", "left_semi"), "jaccard-active")
        if active.isEmpty():
            return labels
        salt = F.pmod(F.xxhash64("c"), F.lit(centres_a_list))
        best = F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "c", "n", "pos", "comp", *SUFFIX)).alias("best")
        centres = active.groupBy("h", salt.alias("salt")).agg(best)
        centres = materialise(centres.select("h", *[F.col(f"best.{x}").alias(f"c{x}") for x in ("c", "n", "pos", "comp", *SUFFIX)]), "jaccard-centres")
        least = F.ceil(num * (F.col("n") + F.col("cn")) / (den + num))
        # At the first shingle that a pair shares, nothing before it is in both. Every list is worked through, so the pair
        # is met there, and in the other lists it may be passed over.
        after = F.least(F.col("n") - F.col("pos"), F.col("cn") - F.col("cpos"))
        behind = F.col("n") - F.col("pos") + F.col("cn") - F.col("cpos") - 2  # of both suffixes
        similar = behind - suffix_distance(SUFFIX, [f"c{x}" for x in SUFFIX]) >= 2 * (least - 1)
        fits = (F.col("comp") != F.col("ccomp")) & (den * F.least("n", "cn") >= num * F.greatest("n", "cn")) & (after >= least) & similar
        met = active.join(centres, (active.h == centres.h) & fits).select(F.least("c", "cc").alias("a"), F.greatest("c", "cc").alias("b"))
        pairs = materialise(met.distinct().join(seen, ["a", "b"], "left_anti"), "jaccard-pairs")
        links = materialise(verify(pairs, classes.select("c", "words"), k, num, den), "jaccard-links")
        if not links.isEmpty():
            of = lambda x: labels.select(F.col("c").alias(x), F.col("comp").alias(f"comp_{x}"))
            joined = components(links.join(of("a"), "a").join(of("b"), "b"), "comp_a", "comp_b").select(F.col("node").alias("comp"), F.col("component").alias("then"))
            labels = materialise(labels.join(joined, "comp", "left").select("c", F.coalesce("then", "comp").alias("comp")), "jaccard-labels")
        seen = seen.unionByName(pairs)
        lists = materialise(active.drop("comp").join(centres.select("h", F.col("cc").alias("c")), ["h", "c"], "left_anti"), "jaccard-lists")
        centres_a_list *= CENTRES


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Written table with a row per document: doc_id, row, digest, n_shingles, component_id, class_id and component.

    Two documents link when den * intersection >= num * union; component_id is the smallest id that links reach,
    class_id the smallest id with the same word sequence. Ids may be null or repeated, so neither tells components
    apart; component does: the smallest digest that links reach, null for documents without words.
    """
    keyed = docs.select(F.col(key).alias("doc_id"), word_sequence(text).alias("words")).withColumn("digest", F.unhex(F.sha2("words", 256)))
    members = materialise(keyed.select("doc_id", "digest", (F.col("words") == "").alias("empty"), F.monotonically_increasing_id().alias("row")), "jaccard-members")
    first = members.filter("not empty").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = materialise(first.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")), "jaccard-first")
    reps = first.select("doc_id", "digest")
    spare = members.join(first.select("row"), "row", "left_anti").select("doc_id", "digest")
    spare = materialise(spare.join(reps, same(spare, reps, {"doc_id": "doc_id", "digest": "digest"}), "left_anti"), "jaccard-spare")
    limit = int(FRACTION * 2**48)
    classes = sketch_classes(keep_rows(keyed, reps, spare, {"doc_id": "doc_id", "digest": "digest"}), k, num, den, limit)
    # First pass: which classes share any shingle of a prefix. Second pass: the join itself, on all shingles of those.
    some = prefix_lists(classes, num, den, limit).select("c").distinct()
    some = materialise(classes.select("c", "doc_id", "digest").join(some, "c", "left_semi").drop("c"), "jaccard-some")
    columns = {"doc_id": "doc_id", "digest": "digest"}
    near, _ = told_apart(keyed, some, columns)
    near = near.join(some.hint("merge"), same(near, some, columns), "left_semi")
    full = sketch_classes(near, k, num, den, 2**48, keep_words=True)
    comps = full.select("c", "digest", "doc_id").join(class_components(full, k, num, den), "c")
    comps = materialise(comps, "jaccard-named")
    smallest = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("digest").alias("component"))
    linked = comps.select("comp", "digest").join(smallest, "comp").groupBy("digest").agg(F.min("component_id").alias("component_id"), F.min("component").alias("component"))
    of_class = classes.groupBy("digest").agg(F.min("n").alias("n"), F.min("doc_id").alias("class_id"))
    of_class = of_class.join(linked, "digest", "left").withColumn("component_id", F.coalesce("component_id", "class_id")).withColumn("component", F.coalesce("component", "digest"))
    of_class = materialise(of_class, "jaccard-classes-named")
    out = members.join(of_class, "digest", "left")
    return materialise(
        out.select(
            "doc_id",
            "row",
            "digest",
            F.coalesce("n", F.lit(0)).alias("n_shingles"),
            F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            "component",
        ),
        "jaccard-groups",
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns; documents without words all stay."""
    groups = near_groups(docs, key, text, k, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    firsts = materialise(firsts.union(groups.filter("n_shingles = 0").select("row")), "near-first")
    keep = materialise(groups.join(firsts, "row", "left_semi").select("doc_id", "digest"), "near-keep")
    spare = materialise(groups.join(firsts, "row", "left_anti").select("doc_id", "digest"), "near-spare")
    twins = materialise(spare.join(keep, same(spare, keep, {"doc_id": "doc_id", "digest": "digest"}), "left_semi").distinct(), "near-twins")
    drop = materialise(spare.join(twins, same(spare, twins, {"doc_id": "doc_id", "digest": "digest"}), "left_anti"), "near-drop")
    digest = fresh(docs, "digest")
    wide = docs.withColumn(digest, F.unhex(F.sha2(word_sequence(text), 256)))
    columns = {key: "doc_id", digest: "digest"}
    kept = keep_rows(wide, keep, drop, columns)
    if twins.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twins, same(kept, twins, columns), "left_anti")
    return once.unionByName(kept.join(twins, same(kept, twins, columns), "left_semi").dropDuplicates([key, digest])).select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "class_id")
