"""Queries by operator id, each with its SQL where SQL can express it, over views derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: View texts that Spark and DuckDB both read; {table} stands for a driver table.
VIEWS = {
    "det": """SELECT CAST(floor(event_id / 100) AS BIGINT) AS image_id, CAST((event_id * 7) % 25 AS INT) AS class_id, event_id AS ord,
  CAST(event_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS score, CAST((event_id * 37) % 90 AS DOUBLE) AS x1, CAST((event_id * 53) % 90 AS DOUBLE) AS y1,
  CAST((event_id * 37) % 90 + 20 + event_id % 7 AS DOUBLE) AS x2, CAST((event_id * 53) % 90 + 20 + event_id % 5 AS DOUBLE) AS y2 FROM {events}""",
    "truth": """SELECT CAST(floor(event_id / 100) AS BIGINT) AS image_id, CAST((event_id * 7 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 25 AS INT) AS class_id, event_id AS ord,
  CAST((event_id * 37) % 90 + 2 AS DOUBLE) AS x1, CAST((event_id * 53) % 90 AS DOUBLE) AS y1,
  CAST((event_id * 37) % 90 + 22 + event_id % 7 AS DOUBLE) AS x2, CAST((event_id * 53) % 90 + 20 + event_id % 5 AS DOUBLE) AS y2, event_id % 41 = 0 AS difficult FROM {events}""",
    "img": """SELECT image_id, 'scene' || CAST(CAST(floor(image_id / 3) AS BIGINT) AS STRING) || '_crop' || CAST(image_id % 3 AS STRING) AS stem,
  'scene' || CAST(CAST(floor(image_id / 3) AS BIGINT) AS STRING) AS group_id, CAST(120 AS INT) AS width, CAST(110 + image_id % 7 AS INT) AS height,
  CASE WHEN image_id % 5 = 0 THEN 'L' ELSE 'RGB' END AS mode FROM (SELECT DISTINCT CAST(floor(event_id / 100) AS BIGINT) AS image_id FROM {events}) e""",
    "nmsbox": """SELECT CAST(floor(event_id / 200) AS BIGINT) AS image_id, CAST(event_id % 3 * 12 AS INT) AS class_id, event_id AS ord, CAST(event_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS score,
  CAST((event_id * 37) % 100 AS DOUBLE) AS x1, CAST((event_id * 53) % 100 AS DOUBLE) AS y1, CAST((event_id * 37) % 100 + 25 + event_id % 40 AS DOUBLE) AS x2,
  CAST((event_id * 53) % 100 + 25 + event_id % 31 AS DOUBLE) AS y2 FROM {events}""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in a fixed number of partitions: for rows of few bytes and much work, which adaptive execution would give to a few tasks."""
    # by a hash of the keys: a shuffle by the keys themselves would be dropped if df comes out of one
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views before it."""
    parts = []
    for n in names:
        text = VIEWS[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({text})")
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql.strip()
        return f

    return keep


def iou_sql(a: str, b: str) -> str:
    both = f"(greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    size = lambda p: f"(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"
    return f"({both} / ({size(a)} + {size(b)} - {both}))"


def coarse_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= 3 THEN 'ship' WHEN {c} <= 23 THEN 'aircraft' ELSE 'vehicle' END)"


def accept_sql(items: str, clash: str) -> str:
    """The items (in order) that clash with none accepted before; clash speaks of k and x."""
    return f"list_reduce(list_transform({items}, lambda e: [e]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {clash.replace('x.', 'y[1].')})) > 0 THEN acc ELSE list_concat(acc, y) END)"


#: The matching of det and truth for all keyings, as common table expressions that end in `matched`.
MATCHED = f"""pk AS (SELECT *, 'all' AS scope, 'all' AS key FROM det UNION ALL SELECT *, 'coarse', {coarse_sql('class_id')} FROM det UNION ALL SELECT *, 'fine', CAST(class_id AS VARCHAR) FROM det),
tk AS (SELECT *, 'all' AS scope, 'all' AS key FROM truth WHERE NOT difficult UNION ALL SELECT *, 'coarse', {coarse_sql('class_id')} FROM truth WHERE NOT difficult UNION ALL SELECT *, 'fine', CAST(class_id AS VARCHAR) FROM truth WHERE NOT difficult),
edges AS (SELECT p.image_id, p.scope, p.key, p.ord AS p, t.ord AS t, p.score AS s, {iou_sql('p', 't')} AS i FROM pk p JOIN tk t ON p.image_id = t.image_id AND p.scope = t.scope AND p.key = t.key
  WHERE {iou_sql('p', 't')} >= CASE WHEN t.class_id = 24 THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END),
lists AS (SELECT image_id, scope, key, list({{'p': p, 't': t, 'i': i, 's': s}} ORDER BY s DESC, p, i DESC, t) AS l FROM edges GROUP BY ALL),
matched AS (SELECT image_id, scope, key, m.p AS p_ord, m.t AS t_ord, m.i AS iou, m.s AS score FROM (SELECT image_id, scope, key, unnest({accept_sql('l', 'k.p = x.p OR k.t = x.t')}) AS m FROM lists))"""
