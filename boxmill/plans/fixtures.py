"""Deterministic views over the given tables that stand in for image label sets and model outputs.

Each view is SQL that Spark and DuckDB run to the same rows; two need a form
for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "lineitem", "events", "embeddings")

VIEWS: dict[str, str | dict[str, str]] = {
    "fx_class": """
SELECT 0 AS class_id, 'container' AS name UNION ALL SELECT 1, 'plastic' UNION ALL SELECT 2, 'metal'
UNION ALL SELECT 3, 'polystyrene' UNION ALL SELECT 4, 'trash_pile' UNION ALL SELECT 5, 'trash'
""",
    "fx_image": """
SELECT o_orderkey AS image_id,
  concat('img_', lpad(CAST(o_orderkey AS VARCHAR(20)), 7, '0'), '.jpg') AS file_name,
  CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  CAST(640 + (o_orderkey % 5) * 160 AS INT) AS width,
  CAST(480 + (o_custkey % 4) * 120 AS INT) AS height
FROM orders
""",
    "fx_box": """
SELECT l_orderkey AS image_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ann_no,
  CAST(l_suppkey % 6 AS INT) AS class_id,
  CAST(((l_partkey % 4) % 2) * 300 + 60 + l_suppkey % 40 AS DOUBLE) AS x1,
  CAST((CASE WHEN l_partkey % 4 >= 2 THEN 220 ELSE 0 END) + 60 + l_partkey % 30 AS DOUBLE) AS y1,
  CAST(120 + CAST(l_quantity AS INT) % 40 AS DOUBLE) AS w,
  CAST(90 + l_linenumber * 5 AS DOUBLE) AS h,
  l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity
FROM lineitem
""",
    "fx_gt": """
SELECT image_id, ann_no AS gt_no, class_id, x1, y1, x1 + w AS x2, y1 + h AS y2
FROM fx_box WHERE l_returnflag <> 'R'
""",
    "fx_det": """
SELECT image_id, ann_no * 3 + source AS det_id, source, class_id,
  x1 + dx AS x1, y1 + dy AS y1, x1 + dx + w AS x2, y1 + dy + h AS y2, score
FROM (SELECT b.*, s.source,
    CAST((l_suppkey * (s.source + 1)) % 50 AS DOUBLE) * s.source / 2 AS dx,
    CAST((l_partkey * (s.source + 1)) % 30 AS DOUBLE) * s.source / 2 AS dy,
    ((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31 + s.source * 613) % 9973 + 1) / CAST(9974 AS DOUBLE) AS score
  FROM fx_box b CROSS JOIN (SELECT 0 AS source UNION ALL SELECT 1 UNION ALL SELECT 2) s) t
WHERE (l_partkey + source) % 4 <> 0
""",
    "fx_label_line": """
SELECT b.image_id, b.ann_no AS line_no,
  CASE WHEN b.l_partkey % 97 = 0 THEN concat(CAST(b.class_id AS VARCHAR(20)), ' 0.5 0.5')
       WHEN b.l_partkey % 89 = 0 THEN 'cls 0.5 0.5 0.1 0.1'
       ELSE concat(CAST(b.class_id AS VARCHAR(20)),
         ' 0.', lpad(CAST(CAST(floor((b.x1 + b.w / 2) * 10000 / i.width) AS INT) AS VARCHAR(20)), 4, '0'),
         ' 0.', lpad(CAST(CAST(floor((b.y1 + b.h / 2) * 10000 / i.height) AS INT) AS VARCHAR(20)), 4, '0'),
         ' 0.', lpad(CAST(CAST(floor(b.w * 10000 / i.width) AS INT) AS VARCHAR(20)), 4, '0'),
         ' 0.', lpad(CAST(CAST(floor(b.h * 10000 / i.height) AS INT) AS VARCHAR(20)), 4, '0')) END AS line
FROM fx_box b JOIN fx_image i ON b.image_id = i.image_id
WHERE b.l_returnflag <> 'R'
""",
    "fx_answer": """
SELECT image_id * 16 + ann_no AS question_id,
  concat('model_', CAST(l_linenumber % 3 AS VARCHAR(20))) AS model,
  CASE l_partkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'popular' ELSE 'adversarial' END AS tier,
  image_id, c.name AS cls,
  CASE WHEN l_returnflag = 'R' THEN 'no' ELSE 'yes' END AS label,
  CASE (l_partkey * 31 + l_suppkey) % 11 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'Yes.' WHEN 2 THEN 'Yes.' WHEN 3 THEN ' yes '
    WHEN 4 THEN 'Yes, it is visible' WHEN 5 THEN 'It is visible' WHEN 6 THEN 'No.' WHEN 7 THEN 'no'
    WHEN 8 THEN 'No, there is not' WHEN 9 THEN 'There cannot be one. Yes' ELSE 'Nothing here' END AS response,
  l_quantity / CAST(10 AS DOUBLE) AS inference_s
FROM fx_box b JOIN fx_class c ON b.class_id = c.class_id
""",
    "fx_epoch": """
SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
  value / CAST(500 AS DOUBLE) AS map5095
FROM events
""",
    "fx_epoch_time": """
SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
  value / CAST(500 AS DOUBLE) AS map5095, ts AS seen
FROM events
""",
    "fx_pixel": {
        "spark": """
SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(floor(i / 8) AS INT) AS y,
  CAST(floor((CAST(e AS DOUBLE) + 1) * 128) AS INT) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, e
""",
        "duckdb": """
SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(floor(i / 8) AS INT) AS y,
  CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 128) AS INT) AS v
FROM embeddings CROSS JOIN range(64) t(i)
""",
    },
    "fx_ground": {
        "spark": """
SELECT image_id, array_join(transform(array_sort(collect_list(struct(ann_no, txt))), s -> s.txt), ' ') AS response
FROM (SELECT b.image_id, b.ann_no, concat(
    CASE WHEN b.l_suppkey % 5 = 0 THEN '' ELSE concat('<ref>', replace(c.name, '_', ' '), '</ref>') END,
    '<box>(', CAST(CAST(b.x1 AS INT) AS VARCHAR(20)), ', y', CAST(CAST(b.y1 AS INT) AS VARCHAR(20)), ', ',
    CAST(CAST(b.x1 + b.w AS INT) AS VARCHAR(20)), ', ', CAST(CAST(b.y1 + b.h AS INT) AS VARCHAR(20)), ')</box>') AS txt
  FROM fx_box b JOIN fx_class c ON b.class_id = c.class_id WHERE b.l_partkey % 4 <> 0) t
GROUP BY image_id
""",
        "duckdb": """
SELECT image_id, string_agg(txt, ' ' ORDER BY ann_no) AS response
FROM (SELECT b.image_id, b.ann_no, concat(
    CASE WHEN b.l_suppkey % 5 = 0 THEN '' ELSE concat('<ref>', replace(c.name, '_', ' '), '</ref>') END,
    '<box>(', CAST(CAST(b.x1 AS INT) AS VARCHAR(20)), ', y', CAST(CAST(b.y1 AS INT) AS VARCHAR(20)), ', ',
    CAST(CAST(b.x1 + b.w AS INT) AS VARCHAR(20)), ', ', CAST(CAST(b.y1 + b.h AS INT) AS VARCHAR(20)), ')</box>') AS txt
  FROM fx_box b JOIN fx_class c ON b.class_id = c.class_id WHERE b.l_partkey % 4 <> 0) t
GROUP BY image_id
""",
    },
}


def _needed(name: str) -> list[str]:
    """The views that name is built from, in order, itself last."""
    sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name]["spark"]
    found: list[str] = []
    for other in VIEWS:
        if other != name and f"{other} " in f"{sql} ".replace("\n", " "):
            found += [x for x in _needed(other) if x not in found]
    return [*found, name]


def with_views(engine: str, *names: str) -> str:
    """The WITH list of the named views and all they need."""
    order: list[str] = []
    for name in names:
        order += [x for x in _needed(name) if x not in order]
    sql = {n: v if isinstance(v, str) else v[engine] for n, v in VIEWS.items()}
    return ",\n".join(f"{n} AS ({sql[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir."""
    body = with_views("spark", name)
    tables = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE if f"{t} " in f"{body} ".replace("\n", " "))
    return spark.sql(f"WITH {tables + ', ' if tables else ''}{body} SELECT * FROM {name}")


def duck(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL over the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_views('duckdb', *names)}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
