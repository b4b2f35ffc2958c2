"""Manifest operators: parsing, validation, lineage, leakage-safe splits, families and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.functions.scalars import unit_hash
from veraframe.operators.graph import components
from veraframe.operators.ordering import running
from veraframe.sources.shared import materialise

#: The manifest's fields, those that must be there, and the closed vocabularies.
SAMPLE_FIELDS = (
    "sample_id dataset_name dataset_version media_type media_path label source_id identity_id parent_sample_id paired_sample_id "
    "manipulation_family generator_method compression_level official_split license_status checksum_sha256 preprocessing_version schema_version"
).split()
REQUIRED = "sample_id dataset_name dataset_version media_type media_path label source_id".split()
LABELS, MEDIA_TYPES = ("real", "fake"), ("image", "video")
SAMPLE_SCHEMA = ", ".join(f"{f} string" for f in SAMPLE_FIELDS) + ", demographic_attrs map<string,string>"


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """Non-blank lines with ``sample`` (a struct) and ``issue`` (the first code that applies, or null).

    A line that is no JSON object is malformed_json; then missing_fields, unsupported_media_type and invalid_label.
    """
    text = F.trim(value)
    out = lines.filter(text != "").withColumn("sample", F.from_json(value, SAMPLE_SCHEMA, {"mode": "PERMISSIVE"}))
    is_object = F.coalesce(F.try_parse_json(value).isNotNull(), F.lit(False)) & text.startswith("{")
    missing = reduce(lambda a, b: a | b, [F.col(f"sample.{f}").isNull() for f in REQUIRED])
    issue = (
        F.when(~is_object, "malformed_json")
        .when(missing, "missing_fields")
        .when(~F.col("sample.media_type").isin(*MEDIA_TYPES), "unsupported_media_type")
        .when(~F.col("sample.label").isin(*LABELS), "invalid_label")
    )
    return out.withColumn("issue", issue)


def read_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """The samples' columns; any bad line fails the call with the count and the first issue."""
    parsed = parse_manifest(lines, value)
    bad = parsed.filter("issue IS NOT NULL")
    first = bad.select("issue", value).limit(1).collect()
    if first:
        raise ValueError(f"{bad.count()} bad manifest lines, the first: {first[0].issue}")
    return parsed.select("sample.*")


def link_reals(samples: DataFrame) -> DataFrame:
    """(sample_id, parent): each fake's last real of the same source."""
    reals = samples.filter("label = 'real'").groupBy("source_id").agg(F.max("sample_id").alias("parent"))
    return samples.filter("label = 'fake'").select("sample_id", "source_id").join(reals, "source_id", "left").select("sample_id", "parent")


def broken_references(samples: DataFrame) -> DataFrame:
    """(code, sample_id, ref) for parents and pairs that are not in the manifest."""
    ids = samples.select(F.col("sample_id").alias("ref"))
    one = lambda column, code: samples.filter(F.col(column).isNotNull()).select(F.lit(code).alias("code"), "sample_id", F.col(column).alias("ref")).join(ids, "ref", "left_anti")
    return one("parent_sample_id", "broken_parent_reference").unionByName(one("paired_sample_id", "broken_pair_reference")).select("code", "sample_id", "ref")


def pairs_across_splits(samples: DataFrame) -> DataFrame:
    """(sample_id, pair, split, pair_split): pairs whose two sides are in different splits."""
    other = samples.select(F.col("sample_id").alias("paired_sample_id"), F.col("split").alias("pair_split"))
    both = samples.join(other, "paired_sample_id").filter(F.col("split") != F.col("pair_split"))
    return both.select("sample_id", F.col("paired_sample_id").alias("pair"), "split", "pair_split")


def split_leaks(samples: DataFrame) -> DataFrame:
    """(code, key, splits): sources, identities and ids that are in more than one split."""

    def one(column: str, code: str) -> DataFrame:
        groups = samples.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.array_sort(F.collect_set("split")).alias("splits"))
        return groups.filter(F.size("splits") > 1).select(F.lit(code).alias("code"), "key", F.array_join("splits", ",").alias("splits"))

    return one("source_id", "cross_split_source_leakage").unionByName(one("identity_id", "cross_split_identity_leakage")).unionByName(one("sample_id", "cross_split_id"))


def leakage_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, group_key): components over shared source, shared identity, parent and pair; the smallest id is the key.

    Samples of one source are one node from the start, the smallest of their ids, so the graph is one of sources.
    """
    links = ("parent_sample_id", "paired_sample_id")
    known = samples.select("sample_id", "source_id", "identity_id", *links)
    hubs = known.filter("source_id IS NOT NULL AND source_id <> ''").groupBy("source_id").agg(F.min("sample_id").alias("hub"))
    nodes = known.join(hubs, "source_id", "left").select("sample_id", F.coalesce("hub", "sample_id").alias("node"), "identity_id", *links)
    nodes = materialise(nodes, "leakage-nodes")
    named = nodes.filter("identity_id IS NOT NULL AND identity_id <> ''").select("node", "identity_id").distinct()
    edges = [named.join(named.groupBy("identity_id").agg(F.min("node").alias("b")), "identity_id").select(F.col("node").alias("a"), "b")]
    ids = nodes.select(F.col("sample_id").alias("ref"), F.col("node").alias("b"))
    for c in links:
        edges.append(nodes.filter(F.col(c).isNotNull()).select(F.col("node").alias("a"), F.col(c).alias("ref")).join(ids, "ref").select("a", "b"))
    found = components(reduce(DataFrame.union, edges)).withColumnRenamed("component", "group")
    return nodes.join(found, "node", "left").select("sample_id", F.coalesce("group", "node").alias("group_key")).distinct()


def hash_split(groups: DataFrame, key: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """``groups`` with ``split``: the first whose cumulative fraction is above the key's hash."""
    u = unit_hash(F.concat(F.lit(f"{seed}:"), F.col(key)))
    upto, out, names = 0.0, None, list(fractions)
    for n in names[:-1]:
        upto += fractions[n]
        out = (F if out is None else out).when(u < upto, n)
    return groups.withColumn("split", out.otherwise(names[-1]))


def exact_partition(keys: DataFrame, key: str, fractions: tuple[float, float, float], names: tuple[str, str, str], seed: int) -> DataFrame:
    """(key, partition): keys in the order of their hashes, cut by half-even rounded counts; the first takes the rest."""
    n = keys.count()
    second, third = round(fractions[1] * n), round(fractions[2] * n)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    placed = running(keys.select(key, order.alias("order")), [F.col("order")], {"nth": F.lit(1).cast("long")})
    part = F.when(F.col("nth") <= n - second - third, names[0]).when(F.col("nth") <= n - third, names[1]).otherwise(names[2])
    return placed.select(key, part.alias("partition"))


def donor_components(families: DataFrame, family: str = "family_id", donor: str = "donor_family_id") -> DataFrame:
    """(family, component): families linked by donors that are in the table; the smallest family is the key."""
    ids = families.select(family).distinct()
    edges = families.filter(F.col(donor).isNotNull()).select(F.col(family).alias("a"), F.col(donor).alias("b")).distinct()
    found = components(edges.join(ids, F.col("b") == F.col(family), "left_semi"))
    return ids.join(found, F.col(family) == F.col("node"), "left").select(family, F.coalesce("component", family).alias("component"))


def class_balance_weights(samples: DataFrame, source: str = "source_id", label: str = "label") -> DataFrame:
    """``samples`` with weight: one over the source's count times the label's count."""
    by_source = samples.groupBy(source).agg(F.count(F.lit(1)).alias("__s"))
    by_label = samples.groupBy(label).agg(F.count(F.lit(1)).alias("__l"))
    # Labels are two values; sources are joined by key, a hot one being split.
    return samples.join(by_source, source).join(F.broadcast(by_label), label).withColumn("weight", 1 / F.col("__s") / F.col("__l")).drop("__s", "__l")


def match_real_frames(families: DataFrame) -> DataFrame:
    """(family_id, slot, method, frame_index, real_frame_index, real_factor, exact): each fake frame with its slot's real one."""
    reals = families.filter("label = 'real'").select("family_id", "slot", F.col("frame_index").alias("real_frame_index"), F.col("factor").alias("real_factor"))
    fakes = families.filter("label = 'fake'")
    exact = F.col("frame_index") == F.col("real_frame_index")
    return fakes.join(reals, ["family_id", "slot"], "left").select("family_id", "slot", "method", "frame_index", "real_frame_index", "real_factor", exact.alias("exact"))


#: Fixed value: the name of a fake made from a target and a source original.
FAKE_STEM = r"^([0-9]+)_([0-9]+)$"


def with_originals(samples: DataFrame) -> DataFrame:
    """``samples`` with target and source, the originals that a name tells: a real's own, a fake's two, null if malformed."""
    part = lambda i: F.nullif(F.regexp_extract("stem", FAKE_STEM, i), F.lit(""))
    real = F.col("label") == "real"
    return samples.withColumns({"target": F.when(real, F.col("stem")).otherwise(part(1)), "source": F.when(~real, part(2))})


def family_members(samples: DataFrame, methods: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(members, problems) of content families: an original and exactly one fake of each method.

    ``samples`` has sample_id, stem, label, method, official_split, checksum_sha256 and what leakage groups need. Members
    are (family_id, sample_id, method, split, donor, leakage_group); problems are (code, key), the key being a sample or
    a family. A fake must have a donor, the lineage that its name tells, and its parents' split and leakage group.
    """
    groups = leakage_groups(samples).withColumnRenamed("group_key", "leakage_group")
    named = materialise(with_originals(samples).join(groups, "sample_id"), "family-samples")
    reals = named.filter("label = 'real'").groupBy("target").agg(F.max(F.struct("sample_id", "official_split", "checksum_sha256", "leakage_group")).alias("r"), F.count(F.lit(1)).alias("n"))
    reals = materialise(reals.select("target", "n", "r.*"), "family-reals")
    fakes = named.filter("label = 'fake' AND target IS NOT NULL")
    found = fakes.groupBy("target").agg(F.array_sort(F.collect_list(F.coalesce("method", F.lit("")))).alias("methods"))
    state = reals.select("target", F.col("sample_id").alias("original"), "n").join(found, "target", "full")
    right = F.coalesce(F.col("methods") == F.array(*map(F.lit, sorted(methods))), F.lit(False))
    code = F.when(F.col("original").isNull(), "original_missing").when(~right, "methods_differ")
    state = materialise(state.select("target", "n", code.alias("code")), "family-state")
    whole = state.filter("code IS NULL").select("target")
    of = lambda p, key: reals.select(F.col("target").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("sample_id", "official_split", "leakage_group")])
    both = fakes.join(whole, "target", "left_semi").join(of("real", "target"), "target").join(of("donor", "source"), "source", "left")
    lineage = F.col("parent_sample_id").eqNullSafe(F.col("real_sample_id")) & F.col("paired_sample_id").eqNullSafe(F.col("donor_sample_id"))
    same = lambda c: (F.col(c) == F.col(f"real_{c}")) & (F.col(c) == F.col(f"donor_{c}"))
    donor = F.col("donor_sample_id").isNotNull()
    checks = [F.when(~donor, "donor_missing"), F.when(donor & ~lineage, "lineage_differs"), F.when(donor & ~F.coalesce(same("official_split"), F.lit(False)), "splits_differ"), F.when(donor & ~same("leakage_group"), "groups_differ")]
    both = materialise(both.withColumn("codes", F.array_compact(F.array(*checks))), "family-fakes")
    kept = both.filter(donor)
    columns = ["sample_id", "method", F.col("official_split").alias("split"), F.col("donor_sample_id").alias("donor"), "leakage_group", "checksum_sha256"]
    originals = reals.join(whole, "target", "left_semi").select(F.col("target").alias("family_id"), "sample_id", F.lit(None).cast("string").alias("method"), F.col("official_split").alias("split"), F.lit(None).cast("string").alias("donor"), "leakage_group", "checksum_sha256")
    members = materialise(kept.select(F.col("target").alias("family_id"), *columns).unionByName(originals), "family-members")
    problems = [
        named.filter("label = 'fake' AND target IS NULL").select(F.lit("not_a_fake_name").alias("code"), F.col("sample_id").alias("key")),
        state.filter("n > 1").select(F.lit("duplicate_original").alias("code"), F.col("target").alias("key")),
        state.filter("code IS NOT NULL").select("code", F.col("target").alias("key")),
        both.select(F.explode("codes").alias("code"), F.col("sample_id").alias("key")),
        members.filter("coalesce(checksum_sha256, '') = ''").select(F.lit("checksum_missing").alias("code"), F.col("family_id").alias("key")).distinct(),
    ]
    return members.drop("checksum_sha256"), reduce(DataFrame.unionByName, problems)


def refuse(problems: DataFrame, what: str, most: int = 50) -> None:
    """Fails with the number of problems and the first of them, if there is any."""
    n = problems.count()
    if n:
        first = [f"{r.code}: {r.key}" for r in problems.orderBy("code", "key").limit(most).collect()]
        raise ValueError(f"{what}: {n} problem(s)\n" + "\n".join(first) + (f"\n... and {n - most} more" if n > most else ""))


def content_families(samples: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The members of all content families; any problem, or a sample in no family, fails the call."""
    members, problems = family_members(samples, methods)
    refuse(problems, "content families")
    refuse(samples.join(members, "sample_id", "left_anti").select(F.lit("no_family").alias("code"), F.col("sample_id").alias("key")), "content families")
    return members


def pair_problems(listed: DataFrame, official: DataFrame) -> DataFrame:
    """(code, key) of split lists (a, b, split) against the official pairs (a, b); the sides of a pair are unordered.

    Pairs that are listed twice, that are not official or are in no split, and originals in two splits or in none.
    """
    key = lambda df, *more: df.select(F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("key"), *more)
    found = key(listed).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = key(official).distinct()
    ids = listed.select(F.explode(F.array("a", "b")).alias("key"), "split").groupBy("key").agg(F.count_distinct("split").alias("n"))
    all_ids = official.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    parts = {
        "pair_listed_twice": found.filter("n > 1"), "pair_not_official": found.join(wanted, "key", "left_anti"), "pair_in_no_split": wanted.join(found, "key", "left_anti"),
        "id_in_two_splits": ids.filter("n > 1"), "id_in_no_split": all_ids.join(ids, "key", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(code).alias("code"), F.col("key").cast("string").alias("key")) for code, df in parts.items()])


def split_assignment(samples: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, problems): (sample_id, split) where a sample's originals tell one split, and all that speaks against it.

    ``listed`` has the pairs of originals (a, b) and their split. Problems are malformed names, originals without a split
    or in different ones, references to samples of another split, and leakage groups that are not in one split.
    """
    of_id = listed.select(F.explode(F.array("a", "b")).alias("original"), "split").groupBy("original").agg(F.min("split").alias("split"))
    named = materialise(with_originals(samples).select("sample_id", "label", "target", "source", "parent_sample_id", "paired_sample_id"), "split-samples")
    each = named.select("sample_id", F.explode(F.array_compact(F.array("target", "source"))).alias("original")).join(of_id, "original", "left")
    splits = each.groupBy("sample_id").agg(F.count_if(F.col("split").isNull()).alias("without"), F.count_distinct("split").alias("n"), F.min("split").alias("split"))
    state = named.join(splits, "sample_id", "left")
    code = F.when((F.col("label") == "fake") & F.col("target").isNull(), "not_a_fake_name").when(F.col("without") > 0, "no_split").when(F.col("n") > 1, "originals_differ")
    state = materialise(state.withColumn("code", code).withColumn("split", F.when(code.isNull(), F.col("split"))), "split-state")
    assigned = state.filter("code IS NULL").select("sample_id", "split")
    refs = state.filter("split IS NOT NULL").select("sample_id", "split", F.explode(F.array_compact(F.array("parent_sample_id", "paired_sample_id"))).alias("ref"))
    refs = refs.join(state.select(F.col("sample_id").alias("ref"), F.col("split").alias("ref_split")), "ref").filter(~F.col("split").eqNullSafe(F.col("ref_split")))
    grouped = leakage_groups(samples).join(state.select("sample_id", "split"), "sample_id").groupBy("group_key").agg(F.count_distinct("split").alias("n"), F.count_if(F.col("split").isNull()).alias("without"))
    problems = [
        state.filter("code IS NOT NULL").select("code", F.col("sample_id").alias("key")),
        refs.select(F.lit("reference_in_other_split").alias("code"), F.col("sample_id").alias("key")),
        grouped.filter("n <> 1 OR without > 0").select(F.lit("group_spans_splits").alias("code"), F.col("group_key").alias("key")),
    ]
    return assigned, reduce(DataFrame.unionByName, problems)


def official_splits(samples: DataFrame, listed: DataFrame, official: DataFrame) -> DataFrame:
    """(sample_id, split) of all samples; any problem of the lists or the samples fails the call, and nothing is assigned."""
    assigned, problems = split_assignment(samples, listed)
    refuse(pair_problems(listed, official).unionByName(problems), "official split")
    return assigned


def aligned_margins(crops: DataFrame, scores: DataFrame, keys: list[str], logits: str) -> DataFrame:
    """``keys``, status and margin (fake less real logit) of crops and scores; what one side lacks is told, not left out."""
    c, s = crops.select(*keys, F.lit(True).alias("__crop")), scores.select(*keys, logits)
    status = F.when(F.col(logits).isNull(), "missing_score").when(F.col("__crop").isNull(), "unknown_crop").otherwise("ok")
    return c.join(s, keys, "full").select(*keys, status.alias("status"), (F.get(logits, F.lit(1)) - F.get(logits, F.lit(0))).alias("margin"))


def partition_rows(rows: DataFrame, partitions: DataFrame, name: str, family: str = "family_id") -> DataFrame:
    """The rows whose family is in partition ``name``; a family that is in none fails the job."""
    mapped = rows.join(partitions.select(family, "partition"), family, "left")
    known = F.when(F.col("partition").isNull(), F.raise_error(F.lit("a family is in no partition")).cast("boolean")).otherwise(F.col("partition") == name)
    return mapped.filter(known).drop("partition")


def only_splits(rows: DataFrame, allowed: list[str], split: str = "split") -> DataFrame:
    """``rows``, if all are of allowed splits; a row of another split fails the job, it is never left out."""
    sealed = F.raise_error(F.concat(F.lit("a row of a sealed split was asked for: "), F.coalesce(F.col(split), F.lit("none")))).cast("boolean")
    return rows.filter(F.when(F.col(split).isin(*allowed), F.lit(True)).otherwise(sealed))


def semantic_issues(samples: DataFrame, listing: DataFrame | None = None, path: str = "media_path") -> DataFrame:
    """(code, key) of all that is wrong with a manifest: repeated ids, missing files, broken references and split leaks.

    ``listing`` has the paths that exist. Leaks need a column ``split``. The key is a sample, or a source or identity.
    """
    again = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("code"), F.col("sample_id").alias("key"), F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    parts = [again.select("code", "key"), broken_references(samples).select("code", F.col("sample_id").alias("key"))]
    if listing is not None:
        parts.append(samples.join(listing.select(path).distinct(), path, "left_anti").select(F.lit("missing_file").alias("code"), F.col("sample_id").alias("key")))
    if "split" in samples.columns:
        once = samples.dropDuplicates(["sample_id"])
        parts += [pairs_across_splits(once).select(F.lit("real_fake_pair_leakage").alias("code"), F.col("sample_id").alias("key")), split_leaks(samples).select("code", "key")]
    return reduce(DataFrame.unionByName, parts)


def pair_shape(listed: DataFrame, pair: str = "pair") -> DataFrame:
    """``listed`` with ``issue``: a pair must be two different ids of three digits; null if it is."""
    ids = F.col(pair)
    shaped = (F.size(ids) == 2) & F.forall(ids, lambda x: F.coalesce(x.rlike("^[0-9]{3}$"), F.lit(False)))
    return listed.withColumn("issue", F.when(ids.isNull() | ~shaped, "not_two_ids").when(F.get(ids, F.lit(0)) == F.get(ids, F.lit(1)), "pair_with_itself"))


def reconcile_pairs(official: DataFrame, found: DataFrame) -> DataFrame:
    """(lo, hi, status): pairs that are missing, unofficial, found more than once, or fine; sides are unordered."""
    sided = lambda df: df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    o = sided(official).distinct().withColumn("official", F.lit(True))
    f = sided(found).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("official").isNull(), "unofficial").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return o.join(f, ["lo", "hi"], "full").select("lo", "hi", status.alias("status"))


def acquisition_report(expected: DataFrame, found: DataFrame, key: str, group: str, size: str) -> DataFrame:
    """Per group: expected, found, missing, unexpected and zero-byte files, and the sizes' range; null groups are unexpected files."""
    e = expected.select(key, group).withColumn("e", F.lit(True))
    f = found.select(key, size).withColumn("f", F.lit(True))
    return e.join(f, key, "full").groupBy(group).agg(
        F.count_if("e").alias("expected"), F.count_if("f").alias("found"), F.count_if(F.col("e") & F.col("f").isNull()).alias("missing"), F.count_if(F.col("f") & F.col("e").isNull()).alias("unexpected"),
        F.count_if(F.col(size) == 0).alias("zero_byte"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"),
    )


def table_digest(df: DataFrame, columns: list[str], order: list[str], rows: int = 4096) -> DataFrame:
    """One row: a digest of the table's rows in order.

    Runs of ``rows`` rows are hashed in order, then runs of as many hashes, until one level has no more than one run,
    and that is hashed at last; so no group has more than ``rows`` entries. ``order`` must be total.
    """
    level = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.sha2(F.concat_ws(":", *columns), 256).alias("h"))
    level = running(level, [F.col(f"o{i}") for i in range(len(order))], {"nth": F.lit(1).cast("long")}).select("nth", "h")
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "h"))), lambda x: x.h), ""), 256).alias(c)
    while True:
        level = materialise(level.groupBy(F.floor((F.col("nth") - 1) / rows).alias("run")).agg(joined("h")).select((F.col("run") + 1).alias("nth"), "h"), "digest-level")
        if level.count() <= rows:
            return level.agg(joined("digest"))


def weighted_draws(df: DataFrame, key: str, weight: Column, n: int, seed: int, epoch: int, cells: int | None = None) -> DataFrame:
    """(draw, key): ``n`` draws with replacement, by seeded uniforms that fall into the keys' cumulative weights.

    Keys and draws are cut into cells of the unit interval, so that they meet in an equi-join with a range condition. There
    are about as many cells as draws or keys, whichever are fewer, unless ``cells`` says otherwise.
    """
    rows = df.select(F.col(key).alias("key"), weight.cast("double").alias("w"))
    total, keys = rows.agg(F.sum("w"), F.count(F.lit(1))).first()
    total, cells = total or 1.0, cells or max(1, min(n, keys))
    spans = running(rows, [F.col("key")], {"upto": F.col("w")}).select("key", ((F.col("upto") - F.col("w")) / total).alias("lo"), (F.col("upto") / total).alias("hi"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))))
    u = unit_hash(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("draw").cast("string")))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("u", u).withColumn("cell", F.floor(F.col("u") * cells))
    return draws.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", F.col("key").alias(key))


def first_duplicates(samples: DataFrame, key: str = "sample_id", order: str = "source_id") -> DataFrame:
    """Keys that come more than once, with how often and the rows after the first."""
    nth = samples.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return nth.filter("nth > 1").groupBy(key).agg(F.count(F.lit(1)).alias("repeats"))
