"""A bounded, display-safe summary of provenance manifests that come as JSON text.

Manifests come from strangers: only named fields are read, texts pass ``display_safe``, and lists end after ``MOST`` items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.functions.scalars import display_safe

#: The longest lists, known action codes, source types with their labels, and those that tell of generation.
MOST = 20
GENERATORS = 3
ACTIONS = (
    "c2pa.created", "c2pa.opened", "c2pa.placed", "c2pa.edited", "c2pa.edited.metadata", "c2pa.color_adjustments", "c2pa.cropped", "c2pa.drawing", "c2pa.filtered",
    "c2pa.orientation", "c2pa.resized", "c2pa.converted", "c2pa.transcoded", "c2pa.repackaged", "c2pa.removed", "c2pa.published", "c2pa.redacted", "c2pa.watermarked",
    "c2pa.unknown", "c2pa.deleted", "c2pa.copied", "c2pa.produced", "c2pa.translated", "c2pa.dubbed", "c2pa.versioned", "c2pa.managed", "c2pa.enhanced", "c2pa.font.edited",
)
SOURCE_TYPE_PREFIX = "http://cv.iptc.org/newscodes/digitalsourcetype/"
SOURCE_TYPES = {
    "digitalCapture": "Captured with a digital device",
    "negativeFilm": "Scanned from negative film",
    "positiveFilm": "Scanned from positive film",
    "print": "Scanned print",
    "humanEdits": "Edited by a person",
    "compositeCapture": "Composite of captures",
    "algorithmicallyEnhanced": "Algorithmically enhanced",
    "dataDrivenMedia": "Data-driven media",
    "digitalArt": "Digital art",
    "virtualRecording": "Virtual recording",
    "compositeSynthetic": "Composite including synthetic elements",
    "trainedAlgorithmicMedia": "Generated by AI (trained algorithmic media)",
    "compositeWithTrainedAlgorithmicMedia": "Composite that includes AI-generated elements",
    "algorithmicMedia": "Generated algorithmically",
    "screenCapture": "Screen capture",
    "minorHumanEdits": "Minor human edits",
}
OTHER_SOURCE_TYPE = "Other source type"
AI_TYPES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia")
RELATIONSHIPS = ("parentOf", "componentOf", "inputTo")
CODE = r"^[A-Za-z0-9_.]{1,64}\z"

CODES = "array<struct<code: string>>"
ACTION = "struct<action: string, when: string, softwareAgent: string, digitalSourceType: string>"
MANIFEST = (
    "struct<title: string, signature_info: struct<common_name: string, issuer: string, alg: string, time: string>, claim_generator_info: array<struct<name: string, version: string>>, "
    f"assertions: array<struct<label: string, data: struct<actions: array<{ACTION}>>>>, "
    "ingredients: array<struct<title: string, format: string, relationship: string, active_manifest: string, manifest_data: string>>>"
)
STORE = f"active_manifest string, manifests map<string, {MANIFEST}>, validation_results struct<activeManifest: struct<success: {CODES}, informational: {CODES}, failure: {CODES}>>"


def listed(items: Column) -> Column:
    """The items without nulls; a null list is empty."""
    return F.coalesce(F.array_compact(items), F.array())


def source_type(uri: Column) -> Column:
    """(code, label, ai_generated) of a source type's address; null for anything else, ``other`` for an unknown term."""
    labels = F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv])
    term = F.substring(uri, len(SOURCE_TYPE_PREFIX) + 1, 200)
    known = term.isin(*SOURCE_TYPES)
    code, label = F.when(known, term).otherwise("other"), F.when(known, F.try_element_at(labels, term)).otherwise(OTHER_SOURCE_TYPE)
    return F.when(uri.startswith(SOURCE_TYPE_PREFIX), F.struct(code.alias("code"), label.alias("label"), (known & term.isin(*AI_TYPES)).alias("ai_generated")))


def action(a: Column) -> Column:
    # An agent is a name, or an object that has one.
    agent = F.when(F.ltrim(a["softwareAgent"]).startswith("{"), F.get_json_object(a["softwareAgent"], "$.name")).otherwise(a["softwareAgent"])
    return F.struct(
        F.when(a["action"].isin(*ACTIONS), a["action"]).otherwise("other").alias("action"),
        display_safe(a["when"], 40).alias("when"),
        display_safe(agent, 60).alias("software_agent"),
        source_type(a["digitalSourceType"]).alias("digital_source_type"),
    )


def ingredient(i: Column) -> Column:
    has = (F.coalesce(i["active_manifest"], F.lit("")) != "") | (F.coalesce(i["manifest_data"], F.lit("")) != "")
    relation = F.when(i["relationship"].isin(*RELATIONSHIPS), i["relationship"]).otherwise("other")
    return F.struct(display_safe(i["title"], 80).alias("title"), display_safe(i["format"], 40).alias("format"), relation.alias("relationship"), has.alias("has_own_credentials"))


def provenance_summary(df: DataFrame, store: str, keep: list[str]) -> DataFrame:
    """keep and the summary of the JSON text in ``store``: signer, times, generators, actions, ingredients and codes.

    A null, broken or empty store has no texts, empty lists, timestamp ``absent`` and manifest_count 0.
    """
    # Parsed once, since many columns are taken from it.
    parsed = df.select(*keep, F.from_json(store, STORE).alias("__s"))
    rows = parsed.select(*keep, F.try_element_at("__s.manifests", F.col("__s.active_manifest")).alias("__m"), F.col("__s.validation_results.activeManifest").alias("__v"), F.coalesce(F.map_keys("__s.manifests"), F.array()).alias("__keys"))
    m = F.col("__m")
    told = F.filter(listed(m["assertions"]), lambda a: a["label"].startswith("c2pa.actions"))
    actions = F.slice(F.flatten(F.transform(told, lambda a: listed(a["data"]["actions"]))), 1, MOST)
    codes = {k: F.array_distinct(F.filter(F.transform(listed(F.col("__v")[k]), lambda c: c["code"]), lambda c: c.rlike(CODE))) for k in ("success", "informational", "failure")}
    sig = m["signature_info"]
    rows = rows.select(
        *keep,
        display_safe(sig["common_name"]).alias("signer_name"),
        display_safe(sig["issuer"]).alias("signer_organization"),
        display_safe(sig["alg"], 16).alias("signer_algorithm"),
        display_safe(sig["time"], 40).alias("signed_at"),
        (F.coalesce(sig["time"], F.lit("")) != "").alias("__timed"),
        F.transform(F.slice(listed(m["claim_generator_info"]), 1, GENERATORS), lambda g: F.struct(display_safe(g["name"], 60).alias("name"), display_safe(g["version"], 30).alias("version"))).alias("claim_generators"),
        display_safe(m["title"], 80).alias("title"),
        F.transform(actions, action).alias("actions"),
        F.transform(listed(F.slice(m["ingredients"], 1, MOST)), ingredient).alias("ingredients"),
        F.size("__keys").alias("manifest_count"),
        *[F.slice(v, 1, MOST).alias(f"{k}_codes") for k, v in codes.items()],
    )
    stamped = F.exists(F.concat("failure_codes", "informational_codes"), lambda c: c.startswith("timeStamp"))
    timestamp = F.when(F.array_contains("success_codes", "timeStamp.trusted"), "trusted").when(stamped, "untrusted").when(F.col("__timed"), "present").otherwise("absent")
    generated = F.exists("actions", lambda a: F.coalesce(a["digital_source_type"]["ai_generated"], F.lit(False)))
    return rows.withColumns({"timestamp": timestamp, "declares_ai_generated": generated}).drop("__timed")
