"""Data sets as manifests: metadata sidecars, folder conventions, and the specs of known data sets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.operators.manifests import SAMPLE_FIELDS, link_reals, with_originals

ROW = "map<string,string>"


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


@dataclass(frozen=True)
class SidecarSpec:
    """Which keys of a sidecar's rows say what; a key that is None says nothing."""

    name: str
    version: str
    license_status: str
    metadata: str = "metadata.jsonl"
    form: str = "jsonl"
    media_type: str = "image"
    path: str = "path"
    label: str = "label"
    real: tuple[str, ...] = ("real", "REAL", "0")
    fake: tuple[str, ...] = ("fake", "FAKE", "1")
    source: str | None = None
    identity: str | None = None
    method: str | None = None
    family: str | None = None
    compression: str | None = None
    split: str | None = None
    parent: str | None = None


@dataclass(frozen=True)
class Bucket:
    """A directory whose files are samples of one kind."""

    directory: str
    label: str
    family: str | None = None
    method: str | None = None
    compression: str | None = None


@dataclass(frozen=True)
class FolderSpec:
    """Buckets of files. ``pattern`` has one group, the source id; a name that it does not match is its own source."""

    name: str
    version: str
    license_status: str
    buckets: tuple[Bucket, ...]
    media_type: str = "video"
    pattern: str = r"^([^.]+)\."
    test_list: str | None = None
    two_parents: bool = False


def read_sidecar(spark: SparkSession, path: str, form: str, path_key: str = "path") -> DataFrame:
    """(row: map of strings) of a sidecar: ``jsonl``, ``csv`` with a header, or ``json``, a list of rows or a map from paths.

    A map's key is the path of a row that has none of its own. Blank lines are passed over.
    """
    if form == "jsonl":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        return lines.select(F.from_json("value", ROW).alias("row"))
    if form == "csv":
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return table.select(F.create_map(*[x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("row"))
    if form == "json":
        whole = spark.read.text(path, wholetext=True)
        listed = whole.filter(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<{ROW}>")).alias("row"))
        mapped = whole.filter(~F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"map<string,{ROW}>")).alias("key", "row"))
        row = F.coalesce("row", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        keyed = F.when(F.map_contains_key(row, path_key), row).otherwise(F.map_concat(row, F.create_map(F.lit(path_key), F.col("key"))))
        return listed.unionByName(mapped.select(keyed.alias("row")))
    raise ValueError(f"no such form of sidecar: {form}")


def conformed(samples: DataFrame) -> DataFrame:
    """All fields of a manifest in order, null where ``samples`` has none."""
    return samples.select(*[F.col(c) if c in samples.columns else F.lit(None).cast("string").alias(c) for c in SAMPLE_FIELDS])


def sidecar_samples(rows: DataFrame, spec: SidecarSpec) -> DataFrame:
    """Samples of a sidecar's rows; rows with a label of neither vocabulary are left out."""
    of = lambda key: F.lit(None).cast("string") if key is None else F.try_element_at("row", F.lit(key))
    label = F.when(of(spec.label).isin(*spec.real), "real").when(of(spec.label).isin(*spec.fake), "fake")
    parent = F.concat(F.lit(f"{spec.name}:"), of(spec.parent))
    known = rows.withColumn("label", label).filter("label IS NOT NULL")
    return conformed(
        known.select(
            F.concat(F.lit(f"{spec.name}:"), of(spec.path)).alias("sample_id"), F.lit(spec.name).alias("dataset_name"), F.lit(spec.version).alias("dataset_version"),
            F.lit(spec.media_type).alias("media_type"), of(spec.path).alias("media_path"), "label",
            F.coalesce(F.nullif(of(spec.source), F.lit("")), stem(of(spec.path))).alias("source_id"), of(spec.identity).alias("identity_id"),
            parent.alias("parent_sample_id"), parent.alias("paired_sample_id"), of(spec.family).alias("manipulation_family"), of(spec.method).alias("generator_method"),
            of(spec.compression).alias("compression_level"), of(spec.split).alias("official_split"), F.lit(spec.license_status).alias("license_status"), F.lit("1.0").alias("schema_version"),
        )
    )


def list_files(spark: SparkSession, root: str, checksums: bool = False) -> DataFrame:
    """(path, relative to ``root``, bytes and checksum) of all files below; contents are read only for checksums."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "^.*?" + reduce(lambda x, y: x.replace(y, "\\" + y), "\\.+*?()[]{}^$|", root.removeprefix("file:").rstrip("/")) + "/"
    checksum = F.sha2("content", 256) if checksums else F.lit(None).cast("string")
    return files.select(F.regexp_replace("path", base, "").alias("path"), F.col("length").alias("bytes"), checksum.alias("checksum_sha256"))


def listed_paths(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path) of an official list: the last word of each line, with forward slashes."""
    words = F.split(F.trim(value), r"\s+")
    return lines.filter(F.trim(value) != "").select(F.replace(F.element_at(words, -1), F.lit("\\"), F.lit("/")).alias("path")).distinct()


def folder_samples(files: DataFrame, spec: FolderSpec, listed: DataFrame | None = None) -> DataFrame:
    """Samples of the ``files`` (path, checksum_sha256) that are directly in one of the buckets; others are left out.

    Absent buckets are tolerated, but if there is no file of any the call fails. A path in ``listed`` is of split test.
    Fakes are linked to the last real sample of their source, or to both originals that their names tell.
    """
    spark = files.sparkSession
    buckets = spark.createDataFrame([(b.directory, b.label, b.family, b.method, b.compression) for b in spec.buckets], "directory string, label string, manipulation_family string, generator_method string, compression_level string")
    placed = files.withColumns({"directory": F.regexp_extract("path", r"^(.*)/[^/]+$", 1), "file": F.regexp_extract("path", r"([^/]+)$", 1)})
    found = placed.join(F.broadcast(buckets), "directory")  # a spec's buckets
    if found.isEmpty():
        raise ValueError(f"none of the directories of {spec.name} was found, e.g. {spec.buckets[0].directory if spec.buckets else 'none is configured'}")
    source = F.coalesce(F.nullif(F.regexp_extract("file", spec.pattern, 1), F.lit("")), stem(F.col("path")))
    out = found.withColumns({"sample_id": F.concat(F.lit(f"{spec.name}:"), "path"), "source_id": source, "stem": stem(F.col("path"))})
    if listed is not None:
        out = out.join(listed.withColumn("official_split", F.lit("test")), "path", "left")
    else:
        out = out.withColumn("official_split", F.lit(None).cast("string"))
    out = two_parents(out) if spec.two_parents else out.join(link_reals(out), "sample_id", "left").withColumns({"parent_sample_id": F.col("parent"), "paired_sample_id": F.col("parent")})
    named = {"dataset_name": spec.name, "dataset_version": spec.version, "media_type": spec.media_type, "license_status": spec.license_status, "schema_version": "1.0"}
    return conformed(out.withColumnRenamed("path", "media_path").withColumns({k: F.lit(v) for k, v in named.items()}))


def two_parents(samples: DataFrame) -> DataFrame:
    """``samples`` (sample_id, stem, label, compression_level, source_id) with the originals of fakes named target_source.

    Originals have the same compression. The target is the parent and the fake's source id, the source its pair.
    """
    named = with_originals(samples)
    reals = samples.filter("label = 'real'").groupBy("stem", "compression_level").agg(F.max("sample_id").alias("of"))
    for part, name in (("target", "parent_sample_id"), ("source", "paired_sample_id")):
        side = reals.select(F.col("stem").alias(f"{part}_stem"), F.col("compression_level").alias(f"{part}_level"), F.col("of").alias(name))
        fits = (F.col("label") == "fake") & (F.col(part) == F.col(f"{part}_stem")) & F.col("compression_level").eqNullSafe(F.col(f"{part}_level"))
        named = named.join(side, fits, "left").drop(f"{part}_stem", f"{part}_level")
    fake = (F.col("label") == "fake") & F.col("target").isNotNull()
    return named.withColumn("source_id", F.when(fake, F.col("target")).otherwise(F.col("source_id"))).drop("target", "source")


#: The layouts that the data sets' publishers describe.
_SWAPS = ("Deepfakes", "FaceSwap", "FaceShifter")
_METHODS = ("Deepfakes", "Face2Face", "FaceSwap", "NeuralTextures", "FaceShifter")
_LEVELS = ("raw", "c23", "c40")
KNOWN: dict[str, SidecarSpec | FolderSpec] = {
    s.name: s
    for s in (
        FolderSpec(
            "faceforensics++", "v1", "restricted",
            tuple(Bucket(f"original_sequences/youtube/{c}/videos", "real", compression=c) for c in _LEVELS)
            + tuple(Bucket(f"manipulated_sequences/{m}/{c}/videos", "fake", "face-swap" if m in _SWAPS else "reenactment", m, c) for m in _METHODS for c in _LEVELS),
            two_parents=True,
        ),
        FolderSpec("celeb-df-v2", "v2", "restricted", (Bucket("Celeb-real", "real"), Bucket("YouTube-real", "real"), Bucket("Celeb-synthesis", "fake", "face-swap", "Celeb-DF-synthesis")), test_list="List_of_testing_videos.txt"),
        FolderSpec("deeperforensics-1.0", "v1", "restricted", (Bucket("source_videos", "real"), Bucket("manipulated_videos", "fake", "face-swap", "DF-VAE"))),
        SidecarSpec("dfdc", "v1", "restricted", "metadata.json", "json", "video", real=("REAL", "real"), fake=("FAKE", "fake"), split="split", parent="original"),
        SidecarSpec("df40", "v1", "unknown", method="method", family="family", split="split"),
    )
}


def dataset_spec(name: str, version: str | None = None) -> SidecarSpec | FolderSpec:
    """The spec of a known data set; an unknown name or another version is refused."""
    if name not in KNOWN:
        raise KeyError(f"unknown data set {name!r}; known are {sorted(KNOWN)}")
    spec = KNOWN[name]
    if version is not None and spec.version != version:
        raise ValueError(f"{name} is known in version {spec.version}, not {version}")
    return spec


def generic_spec(name: str, version: str, **changes: object) -> SidecarSpec:
    """The spec of any data set with a sidecar."""
    return replace(SidecarSpec(name, version, "unknown"), **changes)


def read_dataset(spark: SparkSession, root: str, spec: SidecarSpec | FolderSpec, checksums: bool = False) -> DataFrame:
    """The samples of the data set at ``root``."""
    if isinstance(spec, SidecarSpec):
        return sidecar_samples(read_sidecar(spark, f"{root}/{spec.metadata}", spec.form, spec.path), spec)
    files = list_files(spark, root, checksums)
    listed = None
    if spec.test_list and not files.filter(F.col("path") == spec.test_list).isEmpty():
        listed = listed_paths(spark.read.text(f"{root}/{spec.test_list}"))
    return folder_samples(files, spec, listed)
