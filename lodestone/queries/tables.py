"""Table operators: profiles, guarded SQL, unions, loads, layers and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.text import percent_value
from lodestone.operators.combine import mixed_value, tagged_union
from lodestone.operators.profile import column_profile, profile_text, require_rows
from lodestone.operators.range_join import interval_join
from lodestone.operators.reconcile import key_differences, load_summary, remaining
from lodestone.plans.guarded_sql import GuardedSql
from lodestone.queries.registry import Tables, query
from lodestone.session import read_table, shared_dir
from lodestone.sources.envelope import export_table, import_documents, read_export, split_valid
from lodestone.sources.layers import attribute_profile, attributes_long, layer_profile, plain_value
from lodestone.sources.mapping import feature_table
from lodestone.sources.records import list_tables, preview


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    rows = [
        f"SELECT {i} AS position, '{name}' AS column_name, '{dtype}' AS dtype, count({name}) AS non_null, "
        f"count(*) AS total FROM {table}"
        for i, (name, dtype) in enumerate(columns)
    ]
    return " UNION ALL ".join(rows)


ORDERS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(_profile_sql("orders", ORDERS))
def column_profile_orders(t: Tables) -> DataFrame:
    """Filled rows per column, from one scan of the table."""
    return column_profile(require_rows(t.orders)).withColumn("position", F.col("position").cast("bigint"))


@query(f"""
    SELECT string_agg('- `' || column_name || '` (' || dtype || ', заполнено: ' || non_null || '/' || total || ')',
                      chr(10) ORDER BY position) AS columns_info
    FROM ({_profile_sql("orders", ORDERS)})""")
def column_profile_text(t: Tables) -> DataFrame:
    return profile_text(column_profile(t.orders))


def guarded(t: Tables, table: str, sql: str) -> DataFrame:
    """Run SQL over one table as `df`."""
    guard = GuardedSql(t.spark, lambda session: read_table(session, t.directory, table))
    outcome = guard.analyse(sql)
    if not outcome.ok:
        raise ValueError(outcome.message)
    return outcome.df


def sql_query(name: str, table: str, sql: str) -> None:
    """Register a statement over `df`; the same text is its own check."""

    def run(t: Tables) -> DataFrame:
        return guarded(t, table, sql)

    run.__name__ = name
    query(f"WITH df AS (SELECT * FROM {table}) SELECT * FROM ({sql})")(run)


sql_query(
    "sql_filter_topk",
    "lineitem",
    """SELECT "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag" FROM df
    WHERE "l_discount" > 0.05 AND "l_discount" IS NOT NULL
    ORDER BY "l_extendedprice" DESC NULLS LAST, "l_orderkey", "l_linenumber" LIMIT 10""",
)
sql_query(
    "sql_group_max",
    "lineitem",
    """SELECT MAX("l_extendedprice") AS max_price, MIN("l_extendedprice") AS min_price, COUNT(*) AS n,
    ROUND(AVG("l_quantity"), 6) AS avg_quantity, ROUND(SUM("l_extendedprice"), 2) AS sum_price,
    "l_returnflag", "l_linestatus" FROM df WHERE "l_extendedprice" IS NOT NULL
    GROUP BY "l_returnflag", "l_linestatus" ORDER BY max_price DESC NULLS LAST""",
)
sql_query(
    "sql_any_value",
    "part",
    """SELECT "p_partkey", ANY_VALUE("p_name") AS some_name, ANY_VALUE("p_type") AS some_type, COUNT(*) AS n FROM df
    GROUP BY "p_partkey\"""",
)
sql_query(
    "sql_like",
    "part",
    """SELECT "p_partkey", "p_name", "p_brand" FROM df WHERE "p_name" LIKE '%ring%' AND "p_brand" LIKE 'Brand#1%'""",
)
sql_query(
    "sql_self_join",
    "lineitem",
    """SELECT a."l_orderkey", a."l_linenumber" AS line, b."l_linenumber" AS later_line
    FROM df a JOIN df b ON a."l_orderkey" = b."l_orderkey" AND a."l_linenumber" < b."l_linenumber"
    AND b."l_extendedprice" > 2 * a."l_extendedprice\"""",
)
sql_query(
    "sql_semi_anti",
    "orders",
    """SELECT "o_orderpriority", COUNT(*) AS n FROM df o
    WHERE EXISTS (SELECT 1 FROM df p WHERE p."o_custkey" = o."o_custkey" AND p."o_orderstatus" = 'P')
    AND NOT EXISTS (SELECT 1 FROM df f WHERE f."o_custkey" = o."o_custkey" AND f."o_totalprice" > 490000)
    GROUP BY "o_orderpriority\"""",
)
sql_query(
    "sql_window",
    "orders",
    """SELECT * FROM (SELECT "o_custkey", "o_orderkey", "o_totalprice",
    RANK() OVER (PARTITION BY "o_custkey" ORDER BY "o_totalprice" DESC, "o_orderkey") AS price_rank,
    LAG("o_orderkey") OVER (PARTITION BY "o_custkey" ORDER BY "o_orderdate", "o_orderkey") AS previous_order,
    COUNT(*) OVER (PARTITION BY "o_custkey" ORDER BY "o_orderdate", "o_orderkey"
                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent
    FROM df) x WHERE price_rank <= 3""",
)
sql_query(
    "sql_sets",
    "orders",
    """(SELECT "o_custkey" FROM df WHERE "o_orderstatus" = 'O' INTERSECT
    SELECT "o_custkey" FROM df WHERE "o_orderstatus" = 'F')
    EXCEPT SELECT "o_custkey" FROM df WHERE "o_orderpriority" = '1-URGENT'""",
)
sql_query(
    "sql_grouping",
    "lineitem",
    """SELECT "l_returnflag", "l_linestatus", COUNT(*) AS n, COUNT(DISTINCT "l_suppkey") AS suppliers,
    SUM("l_quantity") AS quantity FROM df
    GROUP BY GROUPING SETS (("l_returnflag", "l_linestatus"), ("l_returnflag"), ())""",
)
sql_query(
    "sql_cube_rollup",
    "orders",
    """SELECT 'cube' AS kind, "o_orderstatus", "o_orderpriority", COUNT(*) AS n FROM df
    GROUP BY CUBE ("o_orderstatus", "o_orderpriority")
    UNION ALL SELECT 'rollup', "o_orderstatus", "o_orderpriority", COUNT(*) FROM df
    GROUP BY ROLLUP ("o_orderstatus", "o_orderpriority")""",
)
sql_query(
    "sql_distinct_cte",
    "customer",
    """WITH rich AS (SELECT "c_nationkey", "c_mktsegment", "c_acctbal" FROM df WHERE "c_acctbal" > 5000)
    SELECT DISTINCT "c_nationkey", "c_mktsegment" FROM rich
    WHERE "c_acctbal" > (SELECT AVG("c_acctbal") FROM df)""",
)


@query("""
    SELECT CASE WHEN l_discount > 0.05 THEN 'above' ELSE 'below' END AS side, count(*) AS n
    FROM lineitem GROUP BY 1""")
def percent_threshold(t: Tables) -> DataFrame:
    """A threshold given as `0.05%` or as a number compares alike: the sign is only a unit."""
    side = F.when(F.col("l_discount") > percent_value(F.lit("0.05%")), "above").otherwise("below")
    return t.lineitem.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT p_partkey AS key, p_name AS name, p_retailprice::DOUBLE AS amount, p_size::VARCHAR AS detail,
           NULL::INTEGER AS s_nationkey, 'part' AS matched_feature FROM part WHERE p_retailprice > 1000
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, s_name, s_nationkey, 'supplier' FROM supplier""")
def tagged_union_parts(t: Tables) -> DataFrame:
    """Results of different shape in one table; `detail` is a number in one branch and text in the other."""
    branches = {
        "part": t.part.where("p_retailprice > 1000").selectExpr(
            "p_partkey AS key", "p_name AS name", "p_retailprice AS amount", "p_size AS detail"
        ),
        "supplier": t.supplier.selectExpr(
            "s_suppkey AS key", "s_name AS name", "s_acctbal AS amount", "s_name AS detail", "s_nationkey"
        ),
    }
    return tagged_union(branches)


@query("""
    SELECT 'customer' AS matched_feature, c_custkey AS key, 'ARRAY<BIGINT>' AS kind, NULL::DOUBLE AS number, NULL AS text,
        '[' || c_nationkey || ',' || c_custkey || ']' AS json, c_nationkey::BIGINT AS first FROM customer
    UNION ALL SELECT 'part', p_partkey, 'BIGINT', p_size, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'price', p_partkey, 'DOUBLE', p_retailprice, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'supplier', s_suppkey, 'STRING', NULL, s_name, NULL, NULL FROM supplier""")
def tagged_union_mixed(t: Tables) -> DataFrame:
    """A column that is a whole number, a fraction, a text or a list, by branch; each value is read back as what it was."""
    nation, key = F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long")
    branches = {
        "part": t.part.selectExpr("p_partkey AS key", "p_size AS detail"),
        "price": t.part.selectExpr("p_partkey AS key", "p_retailprice AS detail"),
        "supplier": t.supplier.selectExpr("s_suppkey AS key", "s_name AS detail"),
        "customer": t.customer.select(F.col("c_custkey").alias("key"), F.array(nation, key).alias("detail")),
    }
    union = tagged_union(branches, variant=True)
    value = union.select("*", mixed_value("detail").alias("v"))
    first = F.try_variant_get("detail", "$[0]", "bigint").alias("first")
    return value.select("matched_feature", "key", "v.kind", "v.number", "v.text", "v.json", first)


@query("""
    WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN 0 ELSE o_totalprice / 1000 END AS low,
            CASE WHEN o_orderkey % 997 = 0 THEN 1e6 ELSE o_totalprice / 1000 + o_orderkey % 5 / 100 END AS high FROM orders)
    SELECT o_orderkey, count(*) AS events, sum(event_id)::BIGINT AS ids FROM i JOIN events ON value >= low AND value < high GROUP BY 1""")
def range_join_orders(t: Tables) -> DataFrame:
    """Events whose value lies in an order's band of prices: short bands, empty ones, and some that hold everything."""
    all_of_it = F.col("o_orderkey") % 997 == 0
    price = F.col("o_totalprice") / 1000
    bands = t.orders.select(
        "o_orderkey", F.when(all_of_it, F.lit(0.0)).otherwise(price).alias("low"),
        F.when(all_of_it, F.lit(1e6)).otherwise(price + F.col("o_orderkey") % 5 / 100).alias("high"),
    )
    totals = {"events": None, "ids": "event_id"}
    found = interval_join(t.events.select("event_id", "value"), bands, "value", "low", "high", totals=totals)
    return found.groupBy("o_orderkey").agg(F.sum("events").alias("events"), F.sum("ids").alias("ids"))


@query("""
    SELECT to_json(struct_pack(p_partkey := p_partkey, p_name := p_name, p_brand := p_brand, p_type := p_type, p_size := p_size,
               p_retailprice := p_retailprice)) AS document,
           (SELECT count(*) FROM part) AS total
    FROM part ORDER BY p_partkey LIMIT 5""")
def preview_parts(t: Tables) -> DataFrame:
    """First rows as JSON, with the true row count."""
    return preview(t.part, 5, F.col("p_partkey").asc_nulls_last())


@query("""
    SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'orders', count(*) FROM orders""")
def table_list(t: Tables) -> DataFrame:
    """Tables with their row counts."""
    session = t.spark.newSession()
    for name in ("orders", "customer", "lineitem"):
        read_table(session, t.directory, name).createOrReplaceTempView(name)
    return list_tables(session).select("name", "rows")


@query("""
    WITH e AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
    SELECT coalesce(e.doc_id, s.doc_id) AS doc_id, coalesce(e.n, 0)::BIGINT AS expected,
           coalesce(s.n, 0)::BIGINT AS stored
    FROM e FULL JOIN s ON e.doc_id = s.doc_id WHERE coalesce(e.n, 0) <> coalesce(s.n, 0)""")
def load_differences(t: Tables) -> DataFrame:
    """Ids whose row count differs between what was to be stored and what is."""
    return key_differences(t.documents, t.labels, "doc_id")


@query("""
    WITH e AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1),
    j AS (SELECT coalesce(e.n, 0) AS e, coalesce(s.n, 0) AS s FROM e FULL JOIN s ON e.doc_id = s.doc_id)
    SELECT sum(e)::BIGINT AS expected_rows, sum(s)::BIGINT AS stored_rows,
           sum(greatest(e - s, 0))::BIGINT AS missing_rows, sum(greatest(s - e, 0))::BIGINT AS surplus_rows,
           sum(greatest(e - s, 0)) = 0 AND sum(greatest(s - e, 0)) = 0 AS complete,
           sum(s) = 0 AND sum(e) > 0 AS critical FROM j""")
def load_reconcile(t: Tables) -> DataFrame:
    return load_summary(t.documents, t.labels, "doc_id")


@query("""
    SELECT doc_id, lang, source, n_chars FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def resume_remaining(t: Tables) -> DataFrame:
    """Documents that no finished row names."""
    return remaining(t.documents.select("doc_id", "lang", "source", "n_chars"), t.labels, ["doc_id"])


@query("SELECT doc_id::VARCHAR AS _id, text, lang, source, n_chars FROM documents")
def envelope_roundtrip(t: Tables) -> DataFrame:
    """Export to JSON with a manifest, import with a check, and the same rows again."""
    folder = shared_dir(t.spark, "export")
    documents = t.documents.withColumnRenamed("doc_id", "_id")
    export_table(documents, "documents", folder)
    target = f"{folder}/loaded"
    load = import_documents(read_export(t.spark, "documents", folder), target)
    if not load.complete:
        raise RuntimeError("the load is not whole")
    return t.spark.read.parquet(target)


@query("""
    SELECT o_orderpriority AS batch, count(*) FILTER (o_orderstatus <> 'P') AS imported,
           count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1""")
def load_totals(t: Tables) -> DataFrame:
    """Accepted and refused documents; here a document of a pending order has no id."""
    documents = t.orders.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).alias("_id"),
        F.struct("o_orderpriority", "o_totalprice").alias("_source"),
    )
    good, bad = split_valid(documents)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy(F.col("_source.o_orderpriority").alias("batch")).agg(
        F.count_if("valid").alias("imported"), F.count_if(~F.col("valid")).alias("failed")
    )


def features_of_events(t: Tables) -> DataFrame:
    """Events as vector-layer records: the type is the layer, the JSON properties are attributes."""
    point = F.concat(F.lit("POINT ("), "user_id", F.lit(" "), F.col("value").cast("int"), F.lit(")"))
    has_geometry = F.col("event_type") != "error"
    extra = F.create_map(F.lit("amount"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"))
    return t.events.select(
        F.col("event_type").alias("layer"),
        F.col("event_id").alias("id"),
        F.when(has_geometry, point).alias("geometry_wkt"),
        F.when(has_geometry, F.lit(0)).alias("geometry_type"),
        F.map_concat(F.from_json("props", "map<string,string>"), extra).alias("attributes"),
    )


@query("""
    SELECT event_type AS layer, event_id AS id, 'k' AS attribute, json_extract_string(props, '$.k')::BIGINT AS number
    FROM events
    UNION ALL SELECT event_type, event_id, 'amount', NULL FROM events
    UNION ALL SELECT event_type, event_id, 'kind', NULL FROM events""")
def attributes_by_feature(t: Tables) -> DataFrame:
    """Attributes in long form, whole numbers as numbers."""
    rows = attributes_long(features_of_events(t), "layer", "id")
    whole = F.when(F.col("attribute") == "k", plain_value(F.col("value"), "bigint"))
    return rows.select("layer", "id", "attribute", whole.alias("number"))


@query("""
    SELECT event_type AS layer, CASE WHEN event_type <> 'error' THEN 0 END AS geometry_type, count(*) AS features,
           count(*) FILTER (event_type <> 'error') AS with_geometry FROM events GROUP BY 1, 2""")
def layer_profile_events(t: Tables) -> DataFrame:
    return layer_profile(features_of_events(t), "layer")


@query("""
    SELECT event_type AS layer, a.attribute, count(*) AS filled, a.value_type FROM events,
    (VALUES ('k', 'integer'), ('amount', 'real'), ('kind', 'string')) a(attribute, value_type) GROUP BY 1, 2, 4""")
def attribute_profile_events(t: Tables) -> DataFrame:
    return attribute_profile(features_of_events(t), "layer")


@query("""
    WITH p AS (SELECT event_type, unnest(json_keys(props)) AS name FROM events)
    SELECT event_type AS index_name, name AS feature_name, 'long' AS feature_type, NULL::INTEGER AS dimension,
           NULL::VARCHAR AS space_type FROM p GROUP BY ALL
    UNION ALL SELECT event_type, 'event_type', 'text (keyword)', NULL, NULL FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'embedding', 'knn_vector', count(DISTINCT user_id)::INTEGER, 'cosinesimil'
    FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'value', 'unknown', NULL, NULL FROM events GROUP BY ALL""")
def mapping_features(t: Tables) -> DataFrame:
    """Feature table of mappings: one mapping text per event type, made from the keys that occur in it."""
    keys = t.events.select("event_type", "user_id", F.explode(F.json_object_keys("props")).alias("name"))
    held = keys.groupBy("event_type").agg(
        F.collect_set("name").alias("names"), F.countDistinct("user_id").alias("users")
    )
    entries = F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('":{"type":"long"}')))
    mapping = F.concat(
        F.lit('{"properties":{'),
        F.array_join(entries, ","),
        F.lit(',"event_type":{"type":"text","fields":{"keyword":{"type":"keyword","ignore_above":256}}},"value":{},'),
        F.lit('"embedding":{"type":"knn_vector","dimension":'),
        F.col("users").cast("string"),
        F.lit(',"method":{"name":"hnsw","space_type":"cosinesimil","engine":"nmslib"}}}}'),
    )
    mappings = held.select(F.col("event_type").alias("index_name"), mapping.alias("mappings"))
    return feature_table(mappings, "mappings", "index_name").drop("method")
