"""Coordinates: customers as records whose cells hold numbers, lists and junk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.points import bounds, extract_points, first_point, marker_text, point_lines
from lodestone.queries.registry import Tables, query


def records(customers: DataFrame) -> DataFrame:
    """Records with text cells; the form of the cells goes by market segment."""
    x, y = F.col("c_acctbal").cast("string"), (F.col("c_nationkey") * 4).cast("string")

    def cell(a):
        return (
            F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), a, F.lit("\t")))
            .when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]")))
            .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("['"), x, F.lit("','"), y, F.lit("']")))
            .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("["), x, F.lit(",1, "), y))
            # Quoted items with a comma of their own are no numbers.
            .otherwise(F.concat(F.lit("['"), y, F.lit(",5', '"), x, F.lit(",5']")))
        )

    return customers.select(
        F.col("c_custkey").alias("key"),
        F.col("c_nationkey").alias("nation"),
        "c_acctbal",
        cell(x).alias("lon"),
        cell(y).alias("lat"),
        F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("layer_name"),
        F.when(F.col("c_nationkey") > 15, F.col("c_name")).alias("Регион"),
    )


# The same points without the detour over text cells.
PLAIN_SQL = """
    r AS (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS x, (c_nationkey * 4)::DOUBLE AS y,
        CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') THEN true ELSE false END AS good,
        concat_ws(', ', 'layer_name: ' || CASE WHEN c_nationkey > 5 THEN c_mktsegment END,
                  'Регион: ' || CASE WHEN c_nationkey > 15 THEN c_name END) AS label,
        row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
    p AS (SELECT key, nation, x AS lon, y AS lat,
        CASE WHEN label = '' THEN 'Запись ' || n ELSE label END AS info, n
        FROM r WHERE good AND x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90)"""

# The cells parsed in SQL.
CELLS_SQL = """
    c AS (SELECT c_custkey AS key, c_mktsegment AS seg, c_acctbal::VARCHAR AS x, (c_nationkey * 4)::VARCHAR AS y
          FROM customer),
    cells AS (SELECT key, CASE seg WHEN 'BUILDING' THEN ' ' || x || chr(9) WHEN 'AUTOMOBILE' THEN '[' || x || ', ' || y || ']'
        WHEN 'MACHINERY' THEN '[''' || x || ''',''' || y || ''']' WHEN 'HOUSEHOLD' THEN '[' || x || ',1, ' || y
        ELSE y || ',5' END AS lon,
        CASE seg WHEN 'BUILDING' THEN ' ' || y || chr(9) WHEN 'AUTOMOBILE' THEN '[' || x || ', ' || y || ']'
        WHEN 'MACHINERY' THEN '[''' || x || ''',''' || y || ''']' WHEN 'HOUSEHOLD' THEN '[' || x || ',1, ' || y
        ELSE x || ',5' END AS lat FROM c),
    parsed AS (SELECT key, CASE WHEN starts_with(lon, '[') THEN string_split(trim(lon, '[]'), ',')[1] ELSE lon END AS lon,
        CASE WHEN starts_with(lat, '[') THEN string_split(trim(lat, '[]'), ',')[-1] ELSE lat END AS lat FROM cells)"""


@query(f"""
    WITH {PLAIN_SQL}, {CELLS_SQL}, t AS (
        SELECT key, TRY_CAST(trim(lon, ' ''' || chr(9)) AS DOUBLE) AS lon, TRY_CAST(trim(lat, ' ''' || chr(9)) AS DOUBLE) AS lat
        FROM parsed)
    SELECT t.key, t.lon, t.lat, CASE WHEN r.label = '' THEN 'Запись ' || r.n ELSE r.label END AS info
    FROM t JOIN r ON r.key = t.key WHERE t.lon BETWEEN -180 AND 180 AND t.lat BETWEEN -90 AND 90""")
def coord_points(t: Tables) -> DataFrame:
    """Valid points; a record without a label is named by its position among all records."""
    return extract_points(records(t.customer), order_by=["key"], keep=["key"])


@query("""
    SELECT s_suppkey AS key, s_acctbal AS lon, s_nationkey::DOUBLE AS lat, '' AS info FROM supplier
    WHERE s_acctbal BETWEEN -180 AND 180 AND s_nationkey BETWEEN -90 AND 90""")
def coord_points_native(t: Tables) -> DataFrame:
    """Points from a numeric column and a native list."""
    rows = t.supplier.select(
        F.col("s_suppkey").alias("key"),
        F.col("s_acctbal").alias("lon"),
        F.array(F.lit(0.0), F.col("s_nationkey").cast("double")).alias("lat"),
    )
    return extract_points(rows, keep=["key"])


@query("""
    SELECT c_custkey AS position, 'Запись ' || c_custkey || ': Долгота: ' || c_acctbal || ', Широта: ' || c_nationkey * 4
        AS line
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')
    UNION ALL SELECT c_custkey, 'Запись ' || c_custkey || ': Долгота: ' || c_nationkey * 4 || ',5, Широта: ' || c_acctbal
        || ',5' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')""")
def coord_lines(t: Tables) -> DataFrame:
    """Lines for a summary: cells stay text, and no range is checked."""
    return point_lines(records(t.customer), "key")


@query(f"""
    WITH {PLAIN_SQL}
    SELECT nation, count(*) AS points, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat
    FROM p GROUP BY nation""")
def coord_bbox(t: Tables) -> DataFrame:
    """Bounding box and number of points per nation."""
    return bounds(extract_points(records(t.customer), keep=["nation"]), "nation")


@query(f"""
    WITH {PLAIN_SQL}
    SELECT nation, arg_min(lon, key) AS centre_lon, arg_min(lat, key) AS centre_lat FROM p GROUP BY nation""")
def coord_centre(t: Tables) -> DataFrame:
    """The first point of each nation."""
    return first_point(extract_points(records(t.customer), keep=["nation", "key"]), "key", "nation")


@query(f"""
    WITH {PLAIN_SQL}
    SELECT key, info AS balloon, 'Долгота: ' || lon || ', Широта: ' || lat AS hint FROM p""")
def map_markers(t: Tables) -> DataFrame:
    """Balloon and hint of each marker."""
    points = extract_points(records(t.customer), order_by=["key"], keep=["key"])
    return marker_text(points, "key").select("key", "balloon", "hint")
