"""Queries over manifests, families, pairs and listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.functions import scalars as S
from veraframe.operators import manifests as M
from veraframe.operators.metrics import auroc, mean_ci
from veraframe.operators.ordering import percentiles
from veraframe.plans.fixtures import VIEWS
from veraframe.plans.registry import registry

QUERIES, ORACLES, query = registry()


def n_rows():
    return F.count(F.lit(1)).alias("n")


PARSED = """, v AS (SELECT line_no, value, CASE WHEN trim(value) LIKE '{%' THEN TRY_CAST(value AS JSON) END AS j FROM raw_lines WHERE trim(value) <> ''),
p AS (SELECT line_no, j, CASE WHEN j IS NULL THEN 'malformed_json' WHEN j->>'sample_id' IS NULL OR j->>'dataset_name' IS NULL OR j->>'dataset_version' IS NULL OR j->>'media_type' IS NULL OR j->>'media_path' IS NULL OR j->>'label' IS NULL OR j->>'source_id' IS NULL THEN 'missing_fields'
  WHEN j->>'media_type' NOT IN ('image', 'video') THEN 'unsupported_media_type' WHEN j->>'label' NOT IN ('real', 'fake') THEN 'invalid_label' END AS issue FROM v)"""


@query("s2_parse_manifest", "raw_lines", PARSED + "SELECT line_no, issue, j->>'sample_id' AS sample_id, j->>'label' AS label FROM p")
def _(get):
    return M.parse_manifest(get("raw_lines")).select("line_no", "issue", F.col("sample.sample_id").alias("sample_id"), F.col("sample.label").alias("label"))


@query("s1_manifest_issues", "raw_lines", PARSED + "SELECT issue, count(*) AS n, min(line_no) AS first_line FROM p WHERE issue IS NOT NULL GROUP BY issue")
def _(get):
    return M.parse_manifest(get("raw_lines")).filter("issue IS NOT NULL").groupBy("issue").agg(n_rows(), F.min("line_no").alias("first_line"))


@query("p1_conform_samples", "samples", "SELECT sample_id, source_id, identity_id, label, coalesce(method, 'original') AS generator_method, '1.0' AS schema_version FROM samples")
def _(get):
    return get("samples").select("sample_id", "source_id", "identity_id", "label", F.coalesce("method", F.lit("original")).alias("generator_method"), F.lit("1.0").alias("schema_version"))


@query("p6_class_method", "samples", "SELECT label, coalesce(method, 'original') AS method, count(*) AS n FROM samples GROUP BY ALL")
def _(get):
    return get("samples").groupBy("label", F.coalesce("method", F.lit("original")).alias("method")).agg(n_rows())


@query("s14_content_digest", "samples", """, h AS (SELECT sha256(sample_id || ':' || source_id) AS h, row_number() OVER (ORDER BY sample_id) - 1 AS n FROM samples), r AS (SELECT n // 4096 AS run, sha256(string_agg(h, '' ORDER BY n)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY run)) AS digest FROM r""")
def _(get):
    return M.table_digest(get("samples"), ["sample_id", "source_id"], ["sample_id"])


@query("s15_record_reuse_check", "samples", """, r AS (SELECT sample_id, CASE WHEN sample_id LIKE '%7' THEN 'x' ELSE source_id END AS source_id FROM samples WHERE sample_id NOT LIKE '%9')
SELECT coalesce(s.sample_id, r.sample_id) AS sample_id, CASE WHEN r.sample_id IS NULL THEN 'not_recorded' ELSE 'changed' END AS status FROM samples s FULL JOIN r USING (sample_id) WHERE s.source_id IS DISTINCT FROM r.source_id""")
def _(get):
    s = get("samples").select("sample_id", "source_id")
    recorded = s.filter(~F.col("sample_id").endswith("9")).select("sample_id", F.when(F.col("sample_id").endswith("7"), "x").otherwise(F.col("source_id")).alias("recorded"))
    return s.join(recorded, "sample_id", "full").filter(~F.col("source_id").eqNullSafe(F.col("recorded"))).select("sample_id", F.when(F.col("recorded").isNull(), "not_recorded").otherwise("changed").alias("status"))


@query("j1_link_fakes_to_reals", "samples", ", r AS (SELECT source_id, max(sample_id) AS parent FROM samples WHERE label = 'real' GROUP BY 1) SELECT sample_id, parent FROM samples LEFT JOIN r USING (source_id) WHERE label = 'fake'")
def _(get):
    return M.link_reals(get("samples"))


@query("j2_two_parent_lineage", "pairs", """, n AS (SELECT CAST(a AS STRING) AS id FROM pairs UNION SELECT CAST(b AS STRING) FROM pairs), f AS (SELECT CAST(a AS STRING) || '_' || CAST(b AS STRING) AS name FROM pairs UNION ALL SELECT CAST(b AS STRING) || '_' || CAST(a + 7 AS STRING) FROM pairs)
SELECT name, t.id AS target, s.id AS source FROM f LEFT JOIN n t ON t.id = split_part(name, '_', 1) LEFT JOIN n s ON s.id = split_part(name, '_', 2)""")
def _(get):
    p = get("pairs")
    pad = lambda c: c.cast("string")
    ids = p.select(pad(F.col("a")).alias("id")).union(p.select(pad(F.col("b")))).distinct()
    names = p.select(F.concat_ws("_", pad(F.col("a")), pad(F.col("b"))).alias("name")).union(p.select(F.concat_ws("_", pad(F.col("b")), pad(F.col("a") + 7))))
    parts = names.withColumns({"t": F.regexp_extract("name", r"^(\d+)_(\d+)$", 1), "s": F.regexp_extract("name", r"^(\d+)_(\d+)$", 2)})
    return parts.join(ids.select(F.col("id").alias("target")), F.col("t") == F.col("target"), "left").join(ids.select(F.col("id").alias("source")), F.col("s") == F.col("source"), "left").select("name", "target", "source")


BROKEN = """, i AS (SELECT sample_id AS ref FROM samples), br AS (SELECT 'broken_parent_reference' AS code, sample_id, parent_sample_id AS ref FROM samples WHERE parent_sample_id IS NOT NULL AND parent_sample_id NOT IN (SELECT ref FROM i)
UNION ALL SELECT 'broken_pair_reference', sample_id, paired_sample_id FROM samples WHERE paired_sample_id IS NOT NULL AND paired_sample_id NOT IN (SELECT ref FROM i))"""


@query("j3_broken_references", "samples", BROKEN + "SELECT * FROM br")
def _(get):
    return M.broken_references(get("samples"))


@query("j4_missing_files", "expected_paths paths_found", "SELECT page_id, path FROM expected_paths e WHERE NOT EXISTS (SELECT 1 FROM paths_found p WHERE p.page_id = e.page_id)")
def _(get):
    return get("expected_paths").join(get("paths_found").select("page_id"), "page_id", "left_anti").select("page_id", "path")


ACROSS = ", ac AS (SELECT s.sample_id, s.paired_sample_id AS pair, s.split, p.split AS pair_split FROM samples s JOIN samples p ON s.paired_sample_id = p.sample_id WHERE s.split <> p.split)"


@query("j5_pairs_across_splits", "samples", ACROSS + "SELECT * FROM ac")
def _(get):
    return M.pairs_across_splits(get("samples"))


LEAKS = "".join(f", l{i} AS (SELECT '{code}' AS code, {c} AS key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM samples WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(DISTINCT split) > 1)" for i, (c, code) in enumerate((("source_id", "cross_split_source_leakage"), ("identity_id", "cross_split_identity_leakage"), ("sample_id", "cross_split_id"))))


@query("l2_split_leaks", "samples", LEAKS + "SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2")
def _(get):
    return M.split_leaks(get("samples"))


#: The samples with some repeated, and a listing without some of their files.
REPEATED = """, twice AS (SELECT * FROM samples UNION ALL SELECT * FROM samples WHERE sample_id LIKE '%77')"""


@query("l9_manifest_validation", "samples", BROKEN.replace("FROM samples WHERE parent", "FROM twice WHERE parent").replace("FROM samples WHERE paired", "FROM twice WHERE paired").replace(", i AS", REPEATED + ", i AS", 1) + ACROSS + LEAKS + """, a AS (SELECT code, sample_id AS key FROM br UNION ALL SELECT 'real_fake_pair_leakage', sample_id FROM ac UNION ALL SELECT code, key FROM l0 UNION ALL SELECT code, key FROM l1 UNION ALL SELECT code, key FROM l2
  UNION ALL SELECT 'duplicate_id', sample_id FROM samples WHERE sample_id LIKE '%77' UNION ALL SELECT 'missing_file', sample_id FROM twice WHERE sample_id LIKE '%13') SELECT code, count(*) AS n, min(key) AS first_key FROM a GROUP BY code""")
def _(get):
    s = get("samples").withColumn("media_path", F.concat("sample_id", F.lit(".mp4")))
    listing = s.filter(~F.col("sample_id").endswith("13")).select("media_path")
    issues = M.semantic_issues(s.unionByName(s.filter(F.col("sample_id").endswith("77"))), listing)
    return issues.groupBy("code").agg(n_rows(), F.min("key").alias("first_key"))


def grouped(body: str, of: str = "samples", more: str = "") -> str:
    """DuckDB SQL over the leakage groups of a view, whose edges are first brought down to one node a source."""
    table = re.sub(r"\{(\w+)\}", r"\1", VIEWS[of])
    others = "".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])}), " for v in more.split())
    return GROUPS.replace("{samples}", table).replace("hub AS", others + "hub AS", 1) + body


GROUPS = """WITH RECURSIVE samples AS ({samples}), hub AS (SELECT source_id, min(sample_id) AS h FROM samples GROUP BY 1), ihub AS (SELECT identity_id, min(sample_id) AS h FROM samples WHERE identity_id <> '' GROUP BY 1),
e0 AS (SELECT sample_id AS a, h AS b FROM samples JOIN hub USING (source_id) UNION SELECT sample_id, h FROM samples JOIN ihub USING (identity_id) UNION SELECT sample_id, parent_sample_id FROM samples WHERE parent_sample_id IN (SELECT sample_id FROM samples)
  UNION SELECT sample_id, paired_sample_id FROM samples WHERE paired_sample_id IN (SELECT sample_id FROM samples)),
src AS (SELECT sample_id, h FROM samples JOIN hub USING (source_id)), e1 AS (SELECT DISTINCT x.h AS a, y.h AS b FROM e0 JOIN src x ON x.sample_id = e0.a JOIN src y ON y.sample_id = e0.b WHERE x.h <> y.h), e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
r AS (SELECT DISTINCT h AS node, h AS seen FROM src UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), g AS (SELECT node, min(seen) AS group_key FROM r GROUP BY node)"""


@query("l1_leakage_groups")
def _(get):
    return M.leakage_groups(get("samples"))


@query("a21_group_sizes")
def _(get):
    return M.leakage_groups(get("samples")).groupBy("group_key").agg(n_rows()).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("groups"))


@query("j19_lineage_in_one_group")
def _(get):
    s = get("samples")
    g = M.leakage_groups(s)
    child = s.filter("parent_sample_id IS NOT NULL").select("sample_id", "parent_sample_id").join(g, "sample_id")
    parent = g.select(F.col("sample_id").alias("parent_sample_id"), F.col("group_key").alias("parent_group"))
    return child.join(parent, "parent_sample_id").select("sample_id", (F.col("group_key") == F.col("parent_group")).alias("same_group"))


UNIT = "(CAST(('0x' || substr(sha256({}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query("f3_unit_hash", "samples", f"SELECT sample_id, round({UNIT.format('sample_id')}, 8) AS u FROM samples")
def _(get):
    return get("samples").select("sample_id", S.unit_hash(F.col("sample_id")).alias("u"))


@query("l4_hash_split")
def _(get):
    return M.hash_split(M.leakage_groups(get("samples")), "group_key", {"train": 0.7, "val": 0.15, "test": 0.15}, 42).select("sample_id", "split")


@query("a1_split_counts", "samples", "SELECT split, label, count(*) AS n FROM samples GROUP BY ALL")
def _(get):
    return get("samples").groupBy("split", "label").agg(n_rows())


@query("a7_split_class_audit", "samples", """, s AS (SELECT source_id, split, label, count(*) AS n FROM samples GROUP BY ALL) SELECT split, label, CAST(sum(n) AS BIGINT) AS samples, count(*) AS sources, round(quantile_cont(n, 0.1), 8) AS p10, round(quantile_cont(n, 0.5), 8) AS p50, round(quantile_cont(n, 0.9), 8) AS p90 FROM s GROUP BY split, label""")
def _(get):
    s = get("samples").groupBy("source_id", "split", "label").agg(n_rows())
    sums = s.groupBy("split", "label").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("sources"))
    return sums.join(percentiles(s, "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["split", "label"]).drop("n"), ["split", "label"])


@query("a11_class_balance_weights", "samples", "SELECT sample_id, round(1.0 / count(*) OVER (PARTITION BY source_id) / count(*) OVER (PARTITION BY label), 8) AS weight FROM samples")
def _(get):
    return M.class_balance_weights(get("samples")).select("sample_id", "weight")


@query("u1_issue_union", "samples", BROKEN + ACROSS + "SELECT code, sample_id FROM br UNION ALL SELECT 'real_fake_pair_leakage', sample_id FROM ac")
def _(get):
    s = get("samples")
    return M.broken_references(s).select("code", "sample_id").unionByName(M.pairs_across_splits(s).select(F.lit("real_fake_pair_leakage").alias("code"), "sample_id"))


@query("u2_membership_difference", "samples", """, m AS (SELECT sample_id, CASE WHEN sample_id LIKE '%3' THEN 'val' ELSE split END AS split FROM samples WHERE sample_id NOT LIKE '%11')
SELECT 'only_left' AS side, sample_id, split FROM (SELECT sample_id, split FROM samples EXCEPT ALL SELECT * FROM m) UNION ALL SELECT 'only_right', sample_id, split FROM (SELECT * FROM m EXCEPT ALL SELECT sample_id, split FROM samples)""")
def _(get):
    s = get("samples").select("sample_id", "split")
    m = s.filter(~F.col("sample_id").endswith("11")).select("sample_id", F.when(F.col("sample_id").endswith("3"), "val").otherwise(F.col("split")).alias("split"))
    return s.exceptAll(m).select(F.lit("only_left").alias("side"), "sample_id", "split").unionByName(m.exceptAll(s).select(F.lit("only_right").alias("side"), "sample_id", "split"))


@query("u3_disjoint_partitions", "families", "SELECT count(*) AS shared FROM (SELECT family_id FROM families WHERE family_id % 2 = 0 INTERSECT SELECT family_id FROM families WHERE family_id % 2 = 1) t")
def _(get):
    f = get("families").select("family_id")
    return f.filter("family_id % 2 = 0").intersect(f.filter("family_id % 2 = 1")).agg(F.count(F.lit(1)).alias("shared"))


@query("u4_expected_names", "expected_paths paths_found", "SELECT path FROM expected_paths EXCEPT SELECT path FROM paths_found")
def _(get):
    return get("expected_paths").select("path").subtract(get("paths_found").select("path"))


@query("k4_first_problems", "samples", BROKEN + "SELECT code, sample_id, (SELECT count(*) FROM br) AS total FROM br ORDER BY code, sample_id LIMIT 50")
def _(get):
    problems = M.broken_references(get("samples"))
    total = problems.agg(F.count(F.lit(1)).alias("total"))
    return problems.orderBy("code", "sample_id").limit(50).select("code", "sample_id").crossJoin(total)


@query("w2_duplicate_marks", "samples", "SELECT source_id, count(*) - 1 AS repeats FROM samples GROUP BY 1 HAVING count(*) > 1")
def _(get):
    return M.first_duplicates(get("samples"), "source_id", "sample_id")


@query("w6_weighted_draws")
def _(get):
    s = get("samples")
    return M.weighted_draws(M.class_balance_weights(s), "sample_id", F.col("weight"), 1000, 7, 1).groupBy("sample_id").agg(F.count(F.lit(1)).alias("draws"))


@query("j7_matched_pairs", "families", ", r AS (SELECT family_id, slot, frame_index AS rx, factor AS rf FROM families WHERE label = 'real') SELECT f.family_id, f.slot, method, frame_index, rx AS real_frame_index, rf AS real_factor, frame_index = rx AS exact FROM families f LEFT JOIN r ON r.family_id = f.family_id AND r.slot = f.slot WHERE label = 'fake'")
def _(get):
    return M.match_real_frames(get("families"))


METHODS = ("m1", "m2", "m3", "m4")
#: Families from the rules: reals (the last sample of a target), fakes by target, what is wrong with each.
ASSEMBLY = """, gm AS (SELECT sample_id, group_key FROM src JOIN g ON src.h = g.node), n AS (SELECT s.*, gm.group_key, CASE WHEN label = 'real' THEN stem WHEN regexp_matches(stem, '^[0-9]+_[0-9]+$') THEN split_part(stem, '_', 1) END AS target,
  CASE WHEN label = 'fake' AND regexp_matches(stem, '^[0-9]+_[0-9]+$') THEN split_part(stem, '_', 2) END AS source FROM samples s JOIN gm USING (sample_id)),
re AS (SELECT DISTINCT ON (target) * FROM n WHERE label = 'real' ORDER BY target, sample_id DESC), rn AS (SELECT target, count(*) AS c FROM n WHERE label = 'real' GROUP BY 1), fk AS (SELECT * FROM n WHERE label = 'fake' AND target IS NOT NULL),
ft AS (SELECT target, string_agg(coalesce(method, ''), ',' ORDER BY coalesce(method, '')) AS ms FROM fk GROUP BY 1), st AS (SELECT coalesce(re.target, ft.target) AS target, CASE WHEN re.target IS NULL THEN 'original_missing' WHEN coalesce(ms, '') <> 'm1,m2,m3,m4' THEN 'methods_differ' END AS code FROM re FULL JOIN ft ON re.target = ft.target),
b AS (SELECT fk.*, re.sample_id AS rid, re.official_split AS rs, re.group_key AS rg, d.sample_id AS did, d.official_split AS ds, d.group_key AS dg FROM fk JOIN st ON st.target = fk.target AND st.code IS NULL JOIN re ON re.target = fk.target LEFT JOIN re d ON d.target = fk.source),
mem AS (SELECT target AS family_id, sample_id, method, official_split AS split, did AS donor, group_key AS leakage_group, checksum_sha256 FROM b WHERE did IS NOT NULL UNION ALL SELECT re.target, sample_id, NULL, official_split, NULL, group_key, checksum_sha256 FROM re JOIN st ON st.target = re.target AND st.code IS NULL),
pr AS (SELECT 'not_a_fake_name' AS code, sample_id AS key FROM n WHERE label = 'fake' AND target IS NULL UNION ALL SELECT 'duplicate_original', target FROM rn WHERE c > 1 UNION ALL SELECT code, target FROM st WHERE code IS NOT NULL UNION ALL SELECT 'donor_missing', sample_id FROM b WHERE did IS NULL
  UNION ALL SELECT 'lineage_differs', sample_id FROM b WHERE did IS NOT NULL AND (parent_sample_id IS DISTINCT FROM rid OR paired_sample_id IS DISTINCT FROM did) UNION ALL SELECT 'splits_differ', sample_id FROM b WHERE did IS NOT NULL AND NOT (official_split = rs AND rs = ds)
  UNION ALL SELECT 'groups_differ', sample_id FROM b WHERE did IS NOT NULL AND NOT (group_key = rg AND rg = dg) UNION ALL SELECT DISTINCT 'checksum_missing', family_id FROM mem WHERE coalesce(checksum_sha256, '') = '')"""


@query("j8_family_problems")
def _(get):
    return M.family_members(get("clips"), METHODS)[1]


@query("j8_family_members")
def _(get):
    return M.family_members(get("clips"), METHODS)[0]


@query("j16_matched_differences", "families", ", r AS (SELECT family_id, slot, factor AS rf FROM families WHERE label = 'real'), d AS (SELECT method, CAST(factor - rf AS DOUBLE) AS d FROM families JOIN r USING (family_id, slot) WHERE label = 'fake') SELECT method, count(*) AS n, round(avg(d), 8) AS mean, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 8) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 8) AS high FROM d GROUP BY method")
def _(get):
    f = get("families")
    reals = f.filter("label = 'real'").select("family_id", "slot", F.col("factor").alias("rf"))
    return mean_ci(f.filter("label = 'fake'").join(reals, ["family_id", "slot"]).select("method", (F.col("factor") - F.col("rf")).cast("double").alias("d")), "d", ["method"])


@query("j18_split_membership", "families", """, c AS (SELECT family_id, CASE WHEN family_id % 10 < 8 THEN 'train' ELSE 'val' END AS split, donor_family_id FROM families)
SELECT DISTINCT c.family_id, c.donor_family_id, c.split, d.split AS donor_split FROM c JOIN c d ON c.donor_family_id = d.family_id WHERE c.split <> d.split""")
def _(get):
    c = get("families").select("family_id", F.when(F.col("family_id") % 10 < 8, "train").otherwise("val").alias("split"), "donor_family_id")
    d = c.select(F.col("family_id").alias("donor_family_id"), F.col("split").alias("donor_split")).distinct()
    return c.join(d, "donor_family_id").filter("split <> donor_split").select("family_id", "donor_family_id", "split", "donor_split").distinct()


@query("a4_family_audit", "families", "SELECT family_id, count(*) AS n, count(*) FILTER (factor >= 200) AS long_turns, round(avg(factor), 8) AS mean_factor FROM families GROUP BY 1")
def _(get):
    return get("families").groupBy("family_id").agg(n_rows(), F.count_if(F.col("factor") >= 200).alias("long_turns"), F.avg("factor").alias("mean_factor"))


@query("a6_quarantine_siblings", "families", """, q AS (SELECT family_id, turn FROM families WHERE factor < 100) SELECT q.family_id, q.turn, coalesce(string_agg(CAST(f.turn AS VARCHAR), ',' ORDER BY f.turn), '') AS siblings FROM q LEFT JOIN families f ON f.family_id = q.family_id AND f.turn <> q.turn GROUP BY q.family_id, q.turn""")
def _(get):
    f = get("families")
    turns = f.groupBy("family_id").agg(F.collect_list("turn").alias("turns"))
    bad = f.filter("factor < 100").select("family_id", "turn").join(turns, "family_id")
    rest = F.array_sort(F.array_except("turns", F.array("turn")))
    return bad.select("family_id", "turn", F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("siblings"))


DONORS = """, ids AS (SELECT DISTINCT family_id AS f FROM families), ed AS (SELECT DISTINCT family_id AS a, donor_family_id AS b FROM families WHERE donor_family_id IN (SELECT f FROM ids)), e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
rc AS (SELECT f AS node, f AS seen FROM ids UNION SELECT rc.node, e2.b FROM rc JOIN e2 ON rc.seen = e2.a), comp AS (SELECT node AS family_id, min(seen) AS component FROM rc GROUP BY 1)"""
#: Components in the order of their hashes, cut by half-even rounded counts.
CUTS = DONORS + """, o AS (SELECT component, row_number() OVER (ORDER BY sha256('42:' || CAST(component AS VARCHAR))) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM comp) c),
part AS (SELECT family_id, comp.component, CASE WHEN nth <= n - CAST(round_even(0.1 * n, 0) AS BIGINT) * 2 THEN 'train' WHEN nth <= n - CAST(round_even(0.1 * n, 0) AS BIGINT) THEN 'temperature' ELSE 'conformal' END AS partition FROM comp JOIN o ON o.component = comp.component)"""


def partitions_of(get) -> DataFrame:
    comps = M.donor_components(get("families"))
    parts = M.exact_partition(comps.select("component").distinct(), "component", (0.8, 0.1, 0.1), ("train", "temperature", "conformal"), 42)
    return comps.join(parts, "component").select("family_id", "component", "partition")


@query("l3_donor_components", "families", DONORS + " SELECT family_id, component FROM comp")
def _(get):
    return M.donor_components(get("families"))


@query("l5_exact_partition", "families", CUTS + " SELECT family_id, component, partition FROM part")
def _(get):
    return partitions_of(get)


@query("l5_partition_counts", "families", CUTS + " SELECT partition, count(*) AS frames, count(*) FILTER (label = 'real') AS originals, count(DISTINCT f.family_id) AS families, count(DISTINCT component) AS components FROM families f JOIN part ON part.family_id = f.family_id GROUP BY partition")
def _(get):
    rows = get("families").join(partitions_of(get), "family_id")
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("label") == "real").alias("originals"), F.count_distinct("family_id").alias("families"), F.count_distinct("component").alias("components"))


@query("p7_partition_members", "families", CUTS + " SELECT f.family_id, turn FROM families f JOIN part ON part.family_id = f.family_id WHERE partition = 'conformal'")
def _(get):
    return M.partition_rows(get("families"), partitions_of(get), "conformal").select("family_id", "turn")


@query("l6_challenge_pool", "families", """, h AS (SELECT DISTINCT family_id, sha256('pool:' || CAST(family_id AS VARCHAR)) AS h FROM families), b AS (SELECT family_id, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS le FROM h)
SELECT family_id FROM b WHERE CAST(CAST(('0x' || le) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < 0.25""")
def _(get):
    f = get("families").select("family_id").distinct()
    return f.filter(S.unit_hash_le(F.concat(F.lit("pool:"), F.col("family_id").cast("string"))) < 0.25)


@query("j13_pair_reconciliation", "pairs", """, f AS (SELECT a, b FROM pairs WHERE a % 5 <> 0 UNION ALL SELECT b, a FROM pairs WHERE a % 7 = 0 UNION ALL SELECT a, a + 3 FROM pairs WHERE a % 11 = 0), g AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM f GROUP BY ALL), o AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi, true AS official FROM pairs)
SELECT coalesce(o.lo, g.lo) AS lo, coalesce(o.hi, g.hi) AS hi, CASE WHEN n IS NULL THEN 'missing' WHEN official IS NULL THEN 'unofficial' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM o FULL JOIN g ON o.lo = g.lo AND o.hi = g.hi""")
def _(get):
    p = get("pairs")
    found = p.filter("a % 5 <> 0").select("a", "b").union(p.filter("a % 7 = 0").select("b", "a")).union(p.filter("a % 11 = 0").select("a", F.col("a") + 3))
    return M.reconcile_pairs(p, found)


@query("j13_pair_problems", "pairs", """, l AS (SELECT a, b, split FROM pairs WHERE a % 5 <> 0 UNION ALL SELECT b, a, 'val' FROM pairs WHERE a % 7 = 0 UNION ALL SELECT a, a + 3, 'test' FROM pairs WHERE a % 11 = 0), k AS (SELECT least(a, b) || '-' || greatest(a, b) AS key, split FROM l), o AS (SELECT DISTINCT least(a, b) || '-' || greatest(a, b) AS key FROM pairs),
i AS (SELECT a AS id, split FROM l UNION ALL SELECT b, split FROM l), oi AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)
SELECT 'pair_listed_twice' AS code, key FROM k GROUP BY key HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'pair_not_official', key FROM k WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT 'pair_in_no_split', key FROM o WHERE key NOT IN (SELECT key FROM k)
UNION ALL SELECT 'id_in_two_splits', CAST(id AS VARCHAR) FROM i GROUP BY id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'id_in_no_split', CAST(id AS VARCHAR) FROM oi WHERE id NOT IN (SELECT id FROM i)""")
def _(get):
    p = get("pairs")
    listed = p.filter("a % 5 <> 0").union(p.filter("a % 7 = 0").select("b", "a", F.lit("val"))).union(p.filter("a % 11 = 0").select("a", F.col("a") + 3, F.lit("test")))
    return M.pair_problems(listed, p)


#: Splits of clips from the rules: the originals' splits, references and leakage groups.
ASSIGN = """, gm AS (SELECT sample_id, group_key FROM src JOIN g ON src.h = g.node), n AS (SELECT s.*, gm.group_key, CASE WHEN label = 'real' THEN stem WHEN regexp_matches(stem, '^[0-9]+_[0-9]+$') THEN split_part(stem, '_', 1) END AS target,
  CASE WHEN label = 'fake' AND regexp_matches(stem, '^[0-9]+_[0-9]+$') THEN split_part(stem, '_', 2) END AS source FROM samples s JOIN gm USING (sample_id)), i AS (SELECT a AS id, split FROM clip_pairs UNION SELECT b, split FROM clip_pairs),
z AS (SELECT n.*, t.split AS ts, o.split AS os FROM n LEFT JOIN i t ON t.id = target LEFT JOIN i o ON o.id = source), c AS (SELECT *, CASE WHEN label = 'fake' AND target IS NULL THEN 'not_a_fake_name' WHEN ts IS NULL OR (label = 'fake' AND os IS NULL) THEN 'no_split' WHEN label = 'fake' AND ts <> os THEN 'originals_differ' END AS code FROM z),
y AS (SELECT *, CASE WHEN code IS NULL THEN ts END AS split FROM c), rf AS (SELECT sample_id, split, parent_sample_id AS ref FROM y UNION ALL SELECT sample_id, split, paired_sample_id FROM y)"""


@query("j14_split_problems")
def _(get):
    return M.split_assignment(get("clips"), get("clip_pairs"))[1]


@query("j14_split_assignment")
def _(get):
    return M.split_assignment(get("clips"), get("clip_pairs"))[0]


@query("s8_pair_list_shape", "pairs", r"""SELECT a, b, CASE WHEN NOT regexp_matches(x, '^[0-9]{3}$') OR NOT regexp_matches(y, '^[0-9]{3}$') THEN 'not_two_ids' WHEN x = y THEN 'pair_with_itself' END AS issue FROM (SELECT a, b, CASE WHEN a % 35 = 0 THEN 'x' ELSE '' END || CASE WHEN a < 1000 THEN lpad(CAST(a AS STRING), 3, '0') ELSE CAST(a AS STRING) END AS x,
  CASE WHEN a % 25 = 0 AND a < 1000 THEN lpad(CAST(a AS STRING), 3, '0') WHEN b < 1000 THEN lpad(CAST(b AS STRING), 3, '0') ELSE CAST(b AS STRING) END AS y FROM pairs) t""")
def _(get):
    name = lambda c: F.when(F.col(c) < 1000, F.lpad(F.col(c).cast("string"), 3, "0")).otherwise(F.col(c).cast("string"))
    x = F.concat(F.when(F.col("a") % 35 == 0, "x").otherwise(""), name("a"))
    y = F.when((F.col("a") % 25 == 0) & (F.col("a") < 1000), name("a")).otherwise(name("b"))
    lists = get("pairs").select("a", "b", F.to_json(F.array(x, y)).alias("json"))
    return M.pair_shape(lists.withColumn("pair", F.from_json("json", "array<string>"))).select("a", "b", "issue")


@query("s7_official_test_list", "paths", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM paths")
def _(get):
    p = get("paths")
    lines = p.filter("page_id % 4 = 0").select(F.concat(F.lit("1 "), F.replace(F.concat(F.lit("root/"), F.col("page_id").cast("string")), F.lit("/"), F.lit("\\"))).alias("value"))
    listed = lines.select(F.element_at(F.split(F.replace(F.element_at(F.split("value", r"\s+"), -1), F.lit("\\"), F.lit("/")), "/"), -1).cast("long").alias("page_id")).withColumn("listed", F.lit(True))
    return p.join(listed, "page_id", "left").select("page_id", F.when(F.col("listed"), "test").otherwise("train").alias("split"))


@query("j15_acquisition_report", "expected_paths paths_found", """, f AS (SELECT page_id, bytes FROM paths_found UNION ALL SELECT -page_id - 1, 0 FROM paths_found WHERE page_id % 50 = 1) SELECT class, count(e.page_id) AS expected, count(f.page_id) AS found, count(*) FILTER (f.page_id IS NULL) AS missing, count(*) FILTER (e.page_id IS NULL) AS unexpected,
  count(*) FILTER (bytes = 0) AS zero_byte, min(bytes) AS min_bytes, max(bytes) AS max_bytes FROM expected_paths e FULL JOIN f ON e.page_id = f.page_id GROUP BY class""")
def _(get):
    p = get("paths_found").select("page_id", F.col("bytes").cast("long").alias("bytes"))
    found = p.unionByName(p.filter("page_id % 50 = 1").select((-F.col("page_id") - 1).alias("page_id"), F.lit(0).cast("long").alias("bytes")))
    return M.acquisition_report(get("expected_paths"), found, "page_id", "class", "bytes")


@query("f10_stem_tokens", "paths", "SELECT page_id, regexp_extract(path, '([^/]+)/?$', 1) AS stem, split_part(path, '/', 3) AS host FROM paths")
def _(get):
    return get("paths").select("page_id", F.regexp_extract("path", "([^/]+)/?$", 1).alias("stem"), F.split_part("path", F.lit("/"), F.lit(3)).alias("host"))


@query("s5_folder_buckets", "paths", "SELECT split_part(path, '/', 4) AS bucket, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM paths GROUP BY 1")
def _(get):
    return get("paths").groupBy(F.split_part("path", F.lit("/"), F.lit(4)).alias("bucket")).agg(n_rows(), F.sum("bytes").alias("bytes"))


@query("s4_sidecar_mapping", "sidecar", "SELECT regexp_extract(path, '([^/]+)\\.mp4$', 1) AS sample_id, CASE label WHEN '1' THEN 'fake' ELSE 'real' END AS label, regexp_extract(original, '([^/]+)\\.mp4$', 1) AS parent FROM sidecar WHERE label IN ('0', '1')")
def _(get):
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.mp4$", 1)
    return get("sidecar").filter(F.col("label").isin("0", "1")).select(stem("path").alias("sample_id"), F.when(F.col("label") == "1", "fake").otherwise("real").alias("label"), stem("original").alias("parent"))


@query("m23_factor_audit", "families", """, r AS (SELECT label, factor, rank() OVER (ORDER BY factor) + (count(*) OVER (PARTITION BY factor) - 1) / 2.0 AS rk FROM families)
SELECT round((sum(rk) FILTER (label = 'fake') - count(*) FILTER (label = 'fake') * (count(*) FILTER (label = 'fake') + 1) / 2) / (count(*) FILTER (label = 'fake') * count(*) FILTER (label = 'real')), 8) AS auroc, round(avg(factor) FILTER (label = 'real'), 8) AS mean_real, round(avg(factor) FILTER (label = 'fake'), 8) AS mean_fake FROM r""")
def _(get):
    f = get("families").withColumn("y", (F.col("label") == "fake").cast("int"))
    means = f.agg(F.avg(F.when(F.col("y") == 0, F.col("factor"))).alias("mean_real"), F.avg(F.when(F.col("y") == 1, F.col("factor"))).alias("mean_fake"))
    return auroc(f, "y", "factor").select("auroc").crossJoin(means)


ORACLES["l1_leakage_groups"] = grouped(" SELECT sample_id, group_key FROM src JOIN g ON src.h = g.node")
ORACLES["a21_group_sizes"] = grouped(", c AS (SELECT group_key, count(*) AS size FROM src JOIN g ON src.h = g.node GROUP BY 1) SELECT size, count(*) AS groups FROM c GROUP BY size")
ORACLES["j19_lineage_in_one_group"] = grouped(", m AS (SELECT sample_id, group_key FROM src JOIN g ON src.h = g.node) SELECT s.sample_id, a.group_key = b.group_key AS same_group FROM samples s JOIN m a ON s.sample_id = a.sample_id JOIN m b ON s.parent_sample_id = b.sample_id")
UNIT_OF_GROUP = UNIT.format("'42:' || group_key")
ORACLES["l4_hash_split"] = grouped(f", m AS (SELECT sample_id, group_key, {UNIT_OF_GROUP} AS u FROM src JOIN g ON src.h = g.node) SELECT sample_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM m")
ORACLES["j8_family_problems"] = grouped(ASSEMBLY + " SELECT code, key FROM pr", "clips")
ORACLES["j8_family_members"] = grouped(ASSEMBLY + " SELECT family_id, sample_id, method, split, donor, leakage_group FROM mem", "clips")
ORACLES["j14_split_assignment"] = grouped(ASSIGN + " SELECT sample_id, split FROM y WHERE code IS NULL", "clips", "clip_pairs")
ORACLES["j14_split_problems"] = grouped(
    ASSIGN
    + """ SELECT code, sample_id AS key FROM y WHERE code IS NOT NULL UNION ALL SELECT 'reference_in_other_split', rf.sample_id FROM rf JOIN y ON y.sample_id = rf.ref WHERE rf.split IS NOT NULL AND y.split IS DISTINCT FROM rf.split
UNION ALL SELECT 'group_spans_splits', group_key FROM y GROUP BY group_key HAVING count(DISTINCT split) <> 1 OR count(*) FILTER (split IS NULL) > 0""",
    "clips",
    "clip_pairs",
)
