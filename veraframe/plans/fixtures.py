"""Views over the driver's tables in the shapes that the operators read. One text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "samples": """
SELECT concat('ds:o', CAST(o_orderkey AS STRING)) AS sample_id,
       concat('s', CAST(o_custkey AS STRING)) AS source_id,
       CASE WHEN o_orderkey % 50 = 0 THEN concat('p', CAST(CAST(floor(o_orderkey / 100) AS BIGINT) AS STRING)) END AS identity_id,
       CASE WHEN o_orderkey % 80 = 1 THEN concat('ds:o', CAST(o_orderkey - 1 AS STRING)) END AS parent_sample_id,
       CASE WHEN o_orderkey % 97 = 5 THEN concat('ds:o', CAST(o_orderkey + 1000 AS STRING)) END AS paired_sample_id,
       CASE WHEN o_orderstatus = 'F' THEN 'real' ELSE 'fake' END AS label,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS method,
       CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
       'video' AS media_type
FROM {orders}""",
    "scored": """
SELECT d.doc_id AS row_key, l.quality AS y, ln(1.0 + d.n_chars) - 6.5 AS logit, d.lang AS method
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "frames": """
SELECT concat('u', CAST(user_id AS STRING), '_', CAST(video AS STRING)) AS sample_id, slot, y, method, logit, q1, q2, q3 FROM (
  SELECT user_id, CAST(floor(nth / 16) AS BIGINT) AS video, CAST(nth % 16 AS INT) AS slot, y, method, logit, q1, q2, q3 FROM (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth,
           CAST(user_id % 2 AS INT) AS y,
           CASE WHEN user_id % 2 = 0 THEN 'original' ELSE concat('m', CAST(user_id % 4 AS STRING)) END AS method,
           ln(1.0 + abs(value)) - 3.0 + 0.8 * (2 * (user_id % 2) - 1) AS logit,
           CAST(event_id % 11 AS DOUBLE) AS q1, CAST(event_id % 7 AS DOUBLE) AS q2, CAST(event_id % 5 AS DOUBLE) AS q3
    FROM {events}) e) t""",
    "families": """
SELECT conv_id AS family_id, turn, CAST(floor(turn / 2) AS INT) AS slot, CASE WHEN turn % 2 = 0 THEN 'original' ELSE concat('m', CAST(conv_id % 4 AS STRING)) END AS method,
       CASE WHEN turn % 2 = 0 THEN 'real' ELSE 'fake' END AS label, CASE WHEN turn % 2 = 1 AND conv_id % 2 = 0 THEN conv_id + 1 WHEN turn % 2 = 1 THEN conv_id - 1 END AS donor_family_id,
       CAST(floor(turn / 2) * 10 + CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS frame_index, CAST(length(text) AS BIGINT) AS factor
FROM {conversations}""",
    "clips": """
SELECT concat('c:', CAST(key AS STRING)) AS sample_id, CAST(t AS STRING) AS source_id, CAST(NULL AS STRING) AS identity_id,
       CASE WHEN key % 113 = 17 THEN concat('clip', CAST(key AS STRING)) WHEN k = 0 THEN CAST(t AS STRING) ELSE concat(CAST(t AS STRING), '_', CAST(donor AS STRING)) END AS stem,
       CASE WHEN k = 0 THEN 'real' ELSE 'fake' END AS label, CASE WHEN k = 0 THEN NULL WHEN key % 101 = 7 THEN 'm9' ELSE concat('m', CAST(k AS STRING)) END AS method,
       CASE WHEN k = 0 OR key % 103 = 9 THEN NULL ELSE concat('c:', CAST(5 * t AS STRING)) END AS parent_sample_id, CASE WHEN k = 0 THEN NULL ELSE concat('c:', CAST(5 * donor AS STRING)) END AS paired_sample_id,
       CASE WHEN key % 107 = 11 THEN 'test' WHEN floor(t / 2) % 10 < 8 THEN 'train' ELSE 'val' END AS official_split, CASE WHEN key % 109 = 13 THEN NULL ELSE concat('h', CAST(key AS STRING)) END AS checksum_sha256
FROM (SELECT key, t, k, t + 1 - 2 * (t % 2) AS donor FROM (SELECT CAST(p_partkey AS BIGINT) AS key, CAST(floor(p_partkey / 5) AS BIGINT) AS t, p_partkey % 5 AS k FROM {part}) x) y""",
    "clip_pairs": """
SELECT CAST(2 * k AS STRING) AS a, CAST(2 * k + 1 AS STRING) AS b, CASE WHEN k % 10 < 8 THEN 'train' ELSE 'val' END AS split
FROM (SELECT DISTINCT CAST(floor(p_partkey / 10) AS BIGINT) AS k FROM {part}) p""",
    "faces": """
SELECT *, x + 0.3 * w + nod AS lx1, y + 0.35 * h AS ly1, x + 0.7 * w + nod AS lx2, y + 0.35 * h AS ly2, x + 0.5 * w + nod AS lx3, y + 0.6 * h + nod AS ly3,
       x + 0.35 * w AS lx4, y + 0.8 * h AS ly4, x + 0.65 * w AS lx5, y + 0.8 * h AS ly5
FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS video_id, CAST(l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END AS INT) AS frame_index,
             30.0 * (l_orderkey % 8) + CAST(l_quantity AS DOUBLE) / 2.0 AS x, CAST(l_discount AS DOUBLE) * 100.0 AS y, 20.0 + CAST(l_tax AS DOUBLE) * 100.0 AS w, CAST(30.0 AS DOUBLE) AS h,
             1.0 - CAST(l_discount AS DOUBLE) AS confidence, l_orderkey * 8 + l_linenumber AS det_key, l_suppkey AS det_key2, CAST(l_suppkey % 3 AS DOUBLE) AS nod
      FROM {lineitem}) t""",
    "marks": """
SELECT family_id, slot, CAST(slot * 10 + CASE WHEN label = 'fake' AND pk % 3 = 0 THEN 1 ELSE 0 END AS INT) AS frame_index, label, CASE WHEN label = 'real' THEN 'original' ELSE concat('m', CAST(family_id % 4 AS STRING)) END AS method,
       CASE WHEN label = 'fake' AND family_id % 2 = 0 THEN 480 ELSE 640 END AS source_width, 60.0 + q AS lx1, 80.0 + tax AS ly1, 160.0 - q / 2 + tax AS lx2, 81.0 AS ly2, 112.0 + tax AS lx3, 120.0 - q / 5 AS ly3, 80.0 AS lx4, 150.0 + q / 9 AS ly4, 145.0 + q / 7 AS lx5, 151.0 AS ly5, 90.0 + q AS w, 110.0 + tax AS h
FROM (SELECT l_orderkey AS family_id, CAST(floor((l_linenumber - 1) / 2) AS INT) AS slot, CASE WHEN l_linenumber % 2 = 1 THEN 'real' ELSE 'fake' END AS label, l_partkey AS pk, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) * 100.0 AS tax FROM {lineitem}) t""",
    "clip_files": """
SELECT CASE WHEN k = 5 THEN concat('other/', CAST(key AS STRING), '.mp4') WHEN k = 0 THEN concat('original_sequences/youtube/', level, '/videos/', CAST(t AS STRING), '.mp4')
            ELSE concat('manipulated_sequences/', CASE k WHEN 1 THEN 'Deepfakes' WHEN 2 THEN 'Face2Face' WHEN 3 THEN 'FaceSwap' ELSE 'NeuralTextures' END, '/', level, '/videos/', CAST(t AS STRING), CASE WHEN key % 19 = 3 THEN 'x' ELSE concat('_', CAST(donor AS STRING)) END, '.mp4') END AS path
FROM (SELECT key, t, k, t + 1 - 2 * (t % 2) AS donor, CASE WHEN t % 7 < 5 THEN 'c23' ELSE 'raw' END AS level FROM (SELECT CAST(p_partkey AS BIGINT) AS key, CAST(floor(p_partkey / 6) AS BIGINT) AS t, p_partkey % 6 AS k FROM {part}) x) y""",
    "thumbs": "SELECT vec_id, embedding, label FROM {embeddings}",
    "media": """
SELECT p_partkey AS media_id, CAST(p_size * 20 AS INT) AS frame_count, CAST(p_size * 0.8 AS DOUBLE) AS duration_s,
       CASE WHEN p_partkey % 4 = 0 THEN 1280 WHEN p_partkey % 4 = 1 THEN 640 ELSE 854 END AS width,
       CASE WHEN p_partkey % 4 = 0 THEN 720 ELSE 480 END AS height,
       CASE WHEN p_partkey % 3 = 0 THEN 'FFD8FFE0' WHEN p_partkey % 3 = 1 THEN '89504E470D0A1A0A' ELSE '0000001866747970' END AS header_hex,
       CASE WHEN p_partkey % 5 = 0 THEN '.mp4' WHEN p_partkey % 5 = 1 THEN '.png' ELSE '.jpg' END AS ext
FROM {part}""",
    "sidecar": """
SELECT concat('v/', CAST(doc_id AS STRING), '.mp4') AS path,
       CASE WHEN toxic = 1 THEN '1' WHEN doc_id % 13 = 0 THEN 'maybe' ELSE '0' END AS label,
       CASE WHEN doc_id % 5 = 0 THEN concat('v/', CAST(doc_id + 1 AS STRING), '.mp4') END AS original
FROM {labels}""",
    "log": """
SELECT event_id, ts, user_id,
       CASE event_type WHEN 'view' THEN 'likely_real' WHEN 'purchase' THEN 'likely_manipulated' ELSE 'uncertain' END AS verdict,
       value AS total_ms
FROM {events}""",
    "pairs": """
SELECT CAST(2 * s_suppkey AS INT) AS a, CAST(2 * s_suppkey + 1 AS INT) AS b,
       CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 < 9 THEN 'val' ELSE 'test' END AS split
FROM {supplier}""",
    "paths": "SELECT page_id, url AS path, length(html) AS bytes FROM {pages}",
    "paths_found": "SELECT page_id, url AS path, length(html) AS bytes FROM {pages} WHERE page_id % 9 <> 0",
    "expected_paths": "SELECT page_id, url AS path, CASE WHEN page_id % 2 = 0 THEN 'original' ELSE 'fake' END AS class FROM {pages}",
    "prov": "SELECT event_id AS asset_id, props AS manifest_json, event_type AS status_raw FROM {events}",
    "docs": "SELECT doc_id, text, source FROM {documents}",
    "epochs": """
SELECT user_id % 20 AS run, event_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS INT) AS epoch, CAST(floor(abs(value) / 20.0) AS DOUBLE) AS metric, CAST(event_id % 13 AS DOUBLE) AS nll
FROM {events}""",
    "listing": """
SELECT key, CASE key % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'm1' ELSE 'm2' END AS class, CAST(key AS STRING) AS stem,
       CASE WHEN key % 23 = 5 THEN concat('tmp', CAST(key AS STRING)) WHEN key % 29 = 7 THEN concat('x', CAST(key AS STRING), '.mp4') WHEN key % 31 = 9 THEN concat(CAST(key AS STRING), '.txt') ELSE concat(CAST(key AS STRING), '.mp4') END AS name,
       CASE WHEN key % 37 = 11 THEN 0 ELSE 1000 * size END AS bytes, key % 41 <> 13 AS readable, 0.5 * CAST(size AS DOUBLE) AS duration_s,
       CASE WHEN key % 4 = 0 THEN 1280 ELSE 640 END AS width, CASE WHEN key % 4 = 0 THEN 720 ELSE 480 END AS height, CASE WHEN key % 5 = 0 THEN 'hevc' ELSE 'h264' END AS codec
FROM (SELECT CAST(p_partkey AS BIGINT) AS key, CAST(p_size AS BIGINT) AS size FROM {part}) t""",
    "stores": """
SELECT event_id AS asset_id, event_id % 3 AS kind, event_id % 4 AS timing, user_id % 3 AS org, CASE WHEN event_id % 101 = 17 THEN '{"manifests": broken' ELSE concat('{"active_manifest":"m1","manifests":{"m0":{},"m1":{"title":"',
       event_type, '","signature_info":{"issuer":"Org ', CAST(user_id % 3 AS STRING), '"', CASE WHEN event_id % 4 = 0 THEN ',"time":"2024"' ELSE '' END,
       '},"assertions":[{"label":"c2pa.hash","data":{}},{"label":"c2pa.actions.v2","data":{"actions":[{"action":"', CASE WHEN event_id % 2 = 0 THEN 'c2pa.created' ELSE 'made' END,
       '","softwareAgent":', CASE WHEN event_id % 2 = 0 THEN '{"name":"Tool"}' ELSE '"www.tool"' END, ',"digitalSourceType":"http://cv.iptc.org/newscodes/digitalsourcetype/', CASE event_id % 3 WHEN 0 THEN 'trainedAlgorithmicMedia' WHEN 1 THEN 'digitalCapture' ELSE 'unheard' END,
       '"},{"action":"c2pa.edited"}]}}],"ingredients":[{"title":"part","relationship":"', CASE WHEN event_id % 5 = 0 THEN 'parentOf' ELSE 'cousinOf' END, '","active_manifest":"m0"}]}},"validation_results":{"activeManifest":{"success":[{"code":"',
       CASE WHEN event_id % 4 = 1 THEN 'timeStamp.trusted' ELSE 'claimSignature.validated' END, '"}],"failure":[{"code":"', CASE WHEN event_id % 4 = 2 THEN 'timeStamp.mismatch' ELSE 'not a code' END, '"}]}}}') END AS store, event_type
FROM {events}""",
    "raw_lines": """
SELECT o_orderkey AS line_no,
       CASE WHEN o_orderkey % 41 = 0 THEN '{"sample_id": broken' WHEN o_orderkey % 43 = 0 THEN '[1]' WHEN o_orderkey % 53 = 0 THEN ''
            ELSE concat('{"sample_id":"ds:o', CAST(o_orderkey AS STRING), '","dataset_name":"ds","dataset_version":"1","media_type":"',
                        CASE WHEN o_orderkey % 31 = 0 THEN 'audio' ELSE 'video' END, '","media_path":"m/', CAST(o_orderkey AS STRING), '.mp4"',
                        CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE concat(',"source_id":"s', CAST(o_custkey AS STRING), '"') END,
                        ',"label":"', CASE WHEN o_orderkey % 29 = 0 THEN 'maybe' WHEN o_orderstatus = 'F' THEN 'real' ELSE 'fake' END, '","license_status":"ok"}') END AS value
FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables in ``sf_dir``."""
    return spark.sql(re.sub(r"\{(" + "|".join(TABLES) + r")\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]))


def duck(names: str, body: str) -> str:
    """SQL for DuckDB: the named views as common table expressions, then ``body`` (which may go on with ``, x AS (...)``)."""
    ctes = ", ".join(f"{n} AS ({re.sub(r'\{(' + '|'.join(TABLES) + r')\}', lambda m: m[1], VIEWS[n])})" for n in names.split())
    return f"WITH RECURSIVE {ctes} {body}"
