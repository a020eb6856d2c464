"""Windows over each user's event values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import int_sql, r6, table, with_sql
from pairloom.operators import windows as ops

QUERIES: dict = {}
SQL: dict = {}

W, S = 20, 10

SERIES_SQL = """ser AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         value, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def series(spark, sf):
    return ops.positions(table(spark, sf, "events"), "user_id", "ts", "event_id", "value")


def chunks_sql(w: int, s: int, src: str = "ser", keys: str = "track_id", name: str = "chk") -> str:
    """Dense windows: every (window, slot) is listed and missing samples are zero."""
    return f"""{name}_k AS (SELECT DISTINCT {keys}, n, unnest(range(0,
    CASE WHEN n <= {w} THEN 1 ELSE CAST(ceil((n - {w}) / {s}) AS BIGINT) + 1 END)) AS chunk FROM {src}),
{name}_g AS (SELECT {keys}, chunk, unnest(range(0, {w})) AS i FROM {name}_k),
{name} AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.chunk, g.i, coalesce(s.value, 0.0) AS value
  FROM {name}_g g LEFT JOIN {src} s ON {' AND '.join(f's.{k.strip()} = g.{k.strip()}' for k in keys.split(','))}
    AND s.pos = g.chunk * {s} + g.i)"""


QUERIES["d00_series"] = series
SQL["d00_series"] = with_sql(SERIES_SQL) + "SELECT * FROM ser"


# 64 numbers of a vector as a short series
def _arrays(spark, sf):
    vec = F.col("embedding").cast("array<double>")
    length = (F.col("vec_id") % 60 + 5).cast("int")
    return table(spark, sf, "embeddings").select("vec_id", F.slice(vec, F.lit(1), length).alias("x"))


_ARR = """arr AS (SELECT vec_id AS track_id, list_slice(embedding::DOUBLE[], 1, vec_id % 60 + 5) AS x FROM embeddings),
arr_n AS (SELECT track_id, len(x) AS n, x FROM arr),
arr_s AS (SELECT track_id, n, unnest(range(0, n)) AS pos, unnest(x) AS value FROM arr_n)"""
QUERIES["d01_chunk_array"] = lambda spark, sf: ops.chunk_array(_arrays(spark, sf), "x", W, S).select(
    "vec_id", "chunk", F.posexplode("samples").alias("i", "value")
).withColumn("value", r6(F.col("value")))
SQL["d01_chunk_array"] = with_sql(_ARR, chunks_sql(W, S, "arr_s")) + (
    "SELECT track_id AS vec_id, chunk, i, round(value, 6) AS value FROM chk"
)

QUERIES["d02_chunk_rows"] = lambda spark, sf: ops.chunk_rows(series(spark, sf), W, S)
SQL["d02_chunk_rows"] = with_sql(SERIES_SQL, chunks_sql(W, S)) + "SELECT * FROM chk"


def _window_features(spark, sf):
    out = ops.window_features(table(spark, sf, "events"), "10 days", "5 days", "user_id", "ts", "value")
    return out.select(
        "track_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n",
        r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "low", "high",
    )


QUERIES["d03_window_features"] = _window_features
WINDOWS_SQL = """win AS (SELECT user_id AS track_id, value,
    unnest([time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01'),
            time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 DAY]) AS ws FROM events),
wf AS (SELECT track_id, ws, count(*) AS n, round(avg(value), 6) AS mean,
    round(stddev_pop(value), 6) + 0.0 AS std, min(value) AS low, max(value) AS high FROM win GROUP BY 1, 2)"""
SQL["d03_window_features"] = with_sql(WINDOWS_SQL) + (
    "SELECT track_id, strftime(ws, '%Y-%m-%d') AS window_start, n, mean, std, low, high FROM wf"
)


# window means as a small vector table (track, chunk, dim, value)
def _vectors(spark, sf):
    base = ops.chunk_rows(series(spark, sf), 8, 4)
    return (
        base.groupBy("track_id", "chunk")
        .agg(F.avg("value").alias("m"), F.max("value").alias("h"))
        .select("track_id", "chunk", F.posexplode(F.array("m", "h")).alias("dim", "value"))
    )


def _counts(spark, sf):
    return ops.tracks(series(spark, sf)).select("track_id", ops.window_count(F.col("n"), 8, 4).alias("chunks"))


_VEC = chunks_sql(8, 4) + """,
vm AS (SELECT track_id, chunk, avg(value) AS m, max(value) AS h FROM chk GROUP BY 1, 2),
vec AS (SELECT track_id, chunk, 0 AS dim, m AS value FROM vm UNION ALL SELECT track_id, chunk, 1, h FROM vm),
cnt AS (SELECT track_id, count(*) AS chunks FROM vm GROUP BY 1)"""


def _fit_sql(start: str) -> str:
    return with_sql(SERIES_SQL, _VEC) + f""",
off AS (SELECT track_id, chunks, {start} AS st FROM cnt),
grid AS (SELECT track_id, st, slot, dim FROM (SELECT *, unnest(range(0, 12)) AS slot FROM off),
  (SELECT unnest([0, 1]) AS dim))
SELECT g.track_id, g.slot, g.dim, round(coalesce(v.value, 0.0), 6) AS value
FROM grid g LEFT JOIN vec v ON v.track_id = g.track_id AND v.chunk = g.slot + g.st AND v.dim = g.dim"""


QUERIES["d04_fit_windows"] = lambda spark, sf: ops.fit_windows(
    _vectors(spark, sf), _counts(spark, sf)
).withColumn("value", r6(F.col("value")))
SQL["d04_fit_windows"] = _fit_sql("0")
QUERIES["d04_fit_windows_training"] = lambda spark, sf: ops.fit_windows(
    _vectors(spark, sf), _counts(spark, sf), training=True
).withColumn("value", r6(F.col("value")))
SQL["d04_fit_windows_training"] = _fit_sql(
    f"{int_sql('42|start', 'track_id')} % (greatest(chunks - 12, 0) + 1)"
)

QUERIES["d05_pad_short"] = lambda spark, sf: _arrays(spark, sf).select(
    "vec_id", F.posexplode(ops.pad_short(F.col("x"), 40)).alias("i", "value")
).withColumn("value", r6(F.col("value")))
SQL["d05_pad_short"] = with_sql(_ARR) + """
SELECT track_id AS vec_id, i, round(coalesce(x[i + 1], 0.0), 6) AS value FROM (
  SELECT track_id, x, unnest(range(0, greatest(40, n))) AS i FROM arr_n)"""

QUERIES["d06_tile_vector"] = lambda spark, sf: ops.tile_vector(
    table(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("v")), 4
).withColumn("v", r6(F.col("v")))
SQL["d06_tile_vector"] = """
SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS v, unnest(range(0, 4)) AS position FROM embeddings"""

QUERIES["d07_pad_to_group_max"] = lambda spark, sf: ops.pad_to_group_max(
    _vectors(spark, sf), _counts(spark, sf).withColumn("batch", F.col("track_id") % 16), "batch"
).withColumn("value", r6(F.col("value")))
SQL["d07_pad_to_group_max"] = with_sql(SERIES_SQL, _VEC) + """,
big AS (SELECT track_id, track_id % 16 AS batch, max(chunks) OVER (PARTITION BY track_id % 16) AS m FROM cnt),
grid AS (SELECT batch, track_id, chunk, dim FROM (SELECT *, unnest(range(0, m)) AS chunk FROM big),
  (SELECT unnest([0, 1]) AS dim))
SELECT g.batch, g.track_id, g.chunk, g.dim, round(coalesce(v.value, 0.0), 6) AS value
FROM grid g LEFT JOIN vec v ON v.track_id = g.track_id AND v.chunk = g.chunk AND v.dim = g.dim"""

QUERIES["d08_framed_chunks"] = lambda spark, sf: ops.framed_chunks(series(spark, sf), 30, 10, 5)
SQL["d08_framed_chunks"] = with_sql(
    SERIES_SQL,
    """fr AS (SELECT track_id, pos // 30 AS frame, pos % 30 AS pos, value,
  least(30, n - (pos // 30) * 30) AS n FROM ser)""",
    chunks_sql(10, 5, "fr", "track_id, frame"),
) + "SELECT * FROM chk"

QUERIES["d09_route_by_duration"] = lambda spark, sf: ops.route_by_duration(
    ops.tracks(series(spark, sf)), "n", 2, 33.0
)
SQL["d09_route_by_duration"] = """
SELECT user_id AS track_id, count(*) AS n, count(*) / 2.0::DOUBLE AS duration,
  CASE WHEN count(*) / 2.0::DOUBLE > 33 THEN 'long' ELSE 'short' END AS route FROM events GROUP BY 1"""

QUERIES["d10_truncate_series"] = lambda spark, sf: ops.truncate_series(series(spark, sf), 30)
SQL["d10_truncate_series"] = with_sql(SERIES_SQL) + (
    "SELECT track_id, pos, value, least(n, 30) AS n FROM ser WHERE pos < 30"
)
