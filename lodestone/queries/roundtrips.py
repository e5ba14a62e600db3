"""Readers and sinks: the driver's tables written out in each format and read back, and what else belongs to a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import fixed
from lodestone.functions.text import generation_failed
from lodestone.operators.points import extract_points
from lodestone.operators.profile import text_column
from lodestone.operators.usage import price_table, report_since, report_text, usage_events, usage_report
from lodestone.plans.catalog import with_descriptions
from lodestone.plans.prompts import match_prompts, question_prompts, speech_prompts, summary_prompts
from lodestone.functions import templates
from lodestone.functions.text import feature_description, feature_name
from lodestone.queries.logs import METERED_SQL, USAGE_SQL, metered, retrieved_block, usage
from lodestone.queries.registry import ORACLES, Tables, query
from lodestone.queries.tables import features_of_events, guarded, mapping_features
from lodestone.queries.texts import ANSWERS_SQL, labelled_answers, sql_any, sql_strip, template_sql
from lodestone.session import shared_dir
from lodestone.sources.envelope import import_directory, read_envelopes, rebuild_catalog, write_catalog_csv, write_envelope
from lodestone.sources.layers import read_project
from lodestone.sources.mapping import list_fields
from lodestone.sources.records import read_records
from lodestone.sources.staged import StagedTable


#: Features of a project file as it is written here, which is one object made in one row.
FILE_FEATURES = 10_000


@query("SELECT p_partkey::VARCHAR AS _id, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def records_roundtrip(t: Tables) -> DataFrame:
    """JSON lines as a record table, its columns found from all rows."""
    path = shared_dir(t.spark, "records")
    t.part.withColumn("_id", F.col("p_partkey").cast("string")).drop("p_partkey").write.json(path)
    return read_records(t.spark, path).select("_id", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _envelopes(t: Tables) -> str:
    """Customers as one envelope per segment, without an id where the balance is negative, and one without documents."""
    folder = shared_dir(t.spark, "envelopes")
    documents = t.customer.select(
        "c_mktsegment",
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).alias("_id"),
        F.struct("c_name", "c_nationkey").alias("_source"),
    )
    for row in t.customer.select("c_mktsegment").distinct().collect():
        segment = row["c_mktsegment"]
        write_envelope(documents.where(F.col("c_mktsegment") == segment).drop("c_mktsegment"), segment, folder)
    write_envelope(documents.limit(0).drop("c_mktsegment"), "EMPTY", folder)
    return folder


@query("""
    SELECT c_mktsegment AS "table", CASE WHEN c_acctbal >= 0 THEN c_custkey::VARCHAR END AS _id, c_name, c_nationkey
    FROM customer""")
def envelope_documents(t: Tables) -> DataFrame:
    """Documents of one-object envelopes, by table."""
    source = t.customer.select("c_name", "c_nationkey").schema
    return read_envelopes(t.spark, f"{_envelopes(t)}/*_export.json", source).select("table", "_id", "_source.*")


@query("SELECT c_custkey::VARCHAR AS _id, c_name, c_nationkey FROM customer")
def envelope_splits(t: Tables) -> DataFrame:
    """One envelope with all customers, read by a task for each 64 KB of it."""
    folder = shared_dir(t.spark, "envelope")
    write_envelope(t.customer.select(F.col("c_custkey").cast("string").alias("_id"), F.struct("c_name", "c_nationkey").alias("_source")), "all", folder)
    before = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        # The ranges are read, and their pieces stored, in here.
        found = read_envelopes(t.spark, f"{folder}/all_export.json", t.customer.select("c_name", "c_nationkey").schema)
    finally:
        t.spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.select("_id", "_source.*")


@query("""
    SELECT c_mktsegment AS "table", count(*) FILTER (c_acctbal >= 0) AS imported, count(*) FILTER (c_acctbal < 0) AS failed,
        count(*) FILTER (c_acctbal >= 0) = 0 AS critical FROM customer GROUP BY 1
    UNION ALL SELECT 'EMPTY', 0, 0, true""")
def envelope_directory(t: Tables) -> DataFrame:
    """All envelopes of a folder loaded, with a summary of each table, an empty one too."""
    return import_directory(t.spark, _envelopes(t), shared_dir(t.spark, "loaded"))


@query("SELECT vec_id::VARCHAR AS _id, text, len(embedding)::BIGINT AS dimension FROM embeddings JOIN documents ON vec_id = doc_id")
def catalog_rebuild(t: Tables) -> DataFrame:
    """A catalog table replaced by documents with vectors, twice."""
    joined = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"))
    documents = joined.select(F.col("vec_id").cast("string").alias("_id"), F.struct("text", "embedding").alias("_source"))
    path = shared_dir(t.spark, "catalog")
    for _ in range(2):
        load = rebuild_catalog(documents, path)
        if not load.complete:
            raise RuntimeError("the load is not whole")
    return StagedTable(t.spark, path).read().select("_id", "text", F.size("embedding").cast("bigint").alias("dimension"))


@query('SELECT p_name AS "Название признака", p_brand AS "Тип данных", p_type AS "Описание" FROM part')
def catalog_csv(t: Tables) -> DataFrame:
    """The catalog as CSV, read back."""
    path = shared_dir(t.spark, "csv")
    write_catalog_csv(t.part.selectExpr("p_name AS feature_name", "p_brand AS feature_type", "p_type AS description"), path)
    return t.spark.read.option("header", True).csv(path)


@query("""
    SELECT event_type AS layer, event_id AS id, CASE WHEN event_type <> 'error'
        THEN 'POINT (' || user_id || ' ' || trunc(value)::BIGINT || ')' END AS geometry_wkt,
        json_extract_string(props, '$.k') AS k FROM events""")
def project_layers(t: Tables) -> DataFrame:
    """Project files, each one object of lists of features by layer; as many files of the events as keep each at about `FILE_FEATURES`."""
    path = shared_dir(t.spark, "project")
    feature = F.struct("id", "geometry_wkt", "attributes")
    features = features_of_events(t)
    count = max(10, -(-features.count() // FILE_FEATURES))
    file = F.pmod(F.xxhash64("id"), F.lit(count)).alias("file")
    layers = features.groupBy(file, "layer").agg(F.collect_list(feature).alias("features"))
    files = layers.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("layer", "features"))).alias("layers"))
    files.select(F.to_json("layers").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_project(t.spark, path).select("layer", "id", "geometry_wkt", F.col("attributes")["k"].alias("k"))


def _mapping_fields(t: Tables) -> DataFrame:
    """Fields of each mapping by name."""
    return list_fields(mapping_features(t), "index_name")


_mapping_fields.__name__ = "mapping_fields"
query(f"SELECT index_name, feature_name, feature_type FROM ({ORACLES['mapping_features']})")(_mapping_fields)


@query("SELECT doc_id, text FROM documents")
def text_search_column(t: Tables) -> DataFrame:
    """The text of each document, in the column that the schema shows."""
    return t.documents.select("doc_id", F.col(text_column(t.documents.select("doc_id", "text").schema)).alias("text"))


@query("SELECT p_retailprice AS lon, p_retailprice AS lat, p_name AS info FROM part WHERE false")
def points_absent(t: Tables) -> DataFrame:
    """Rows without coordinate columns have no points, and no error."""
    return extract_points(t.part)


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) <= 7 AS few FROM (SELECT l_orderkey FROM lineitem LIMIT 7)")
def sql_limit(t: Tables) -> DataFrame:
    """A limit without an order: any rows, but not more of them."""
    found = guarded(t, "lineitem", "SELECT l_orderkey FROM df LIMIT 7")
    return found.agg(F.count("*").alias("rows"), (F.countDistinct("l_orderkey") <= 7).alias("few"))


HEAD = f"{fixed.REPORT_TITLE}\n{fixed.REPORT_UPDATED}2024-02-01\n{'=' * fixed.REPORT_WIDTH}\n\n"
BLOCKS_SQL = ORACLES["usage_text"]


@query(f"""
    SELECT '{HEAD}' || string_agg(block, chr(10) || chr(10) ORDER BY is_total, model) || chr(10) AS report FROM ({BLOCKS_SQL})""")
def usage_report_text(t: Tables) -> DataFrame:
    """The whole usage report as one text."""
    return report_text(usage_report(usage_events(usage(t)), price_table(t.spark)), "2024-02-01")


@query(f"""
    WITH {METERED_SQL}, w AS (SELECT model, p, c FROM u WHERE ts >= TIMESTAMP '2024-01-15'),
    k AS (SELECT model, count(*) AS requests, sum(p + c)::BIGINT AS total_tokens FROM w GROUP BY 1)
    SELECT model, requests, total_tokens, round(total_tokens / 1000 * 1.5::DOUBLE, 6) AS cost, false AS is_total FROM k
    UNION ALL SELECT NULL, sum(requests)::BIGINT, sum(total_tokens)::BIGINT, round(sum(total_tokens / 1000 * 1.5::DOUBLE), 6), true FROM k
    """)
def usage_after_reset(t: Tables) -> DataFrame:
    """The report after a reset counts what was used since."""
    report = report_since(metered(t.events), price_table(t.spark), "2024-01-15 00:00:00")
    return report.select("model", "requests", "total_tokens", F.round("cost", 6).alias("cost"), "is_total")


@query(f"SELECT '{HEAD}{fixed.REPORT_EMPTY}' || chr(10) AS report FROM (SELECT max(ts) AS last FROM events) WHERE last IS NOT NULL")
def usage_reset_text(t: Tables) -> DataFrame:
    """The text of the report when nothing was used since a reset: it says so."""
    last = t.events.agg(F.max("ts")).first()[0]
    return report_text(report_since(metered(t.events).where(F.col("ts") <= F.lit(last)), price_table(t.spark), "2999-01-01 00:00:00"), "2024-02-01")


@query(f"SELECT conv_id * 1000 + turn AS question_id, {template_sql(templates.DESCRIBE_QUESTION, {'user_query': 'text'})} AS prompt FROM conversations")
def question_prompt_table(t: Tables) -> DataFrame:
    """Prompts for descriptions of questions."""
    questions = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return question_prompts(questions)


def _match_sql() -> str:
    places = {"user_query": "n_name", "feature_name": "feature_name", "feature_description": "description"}
    return f"""
    SELECT doc_id % 25 AS question_id, doc_id AS feature_id, {template_sql(templates.MATCH_FEATURE, places)} AS prompt
    FROM ({ORACLES['feature_names']}) JOIN nation ON n_nationkey = doc_id % 25"""


@query(_match_sql())
def match_prompt_table(t: Tables) -> DataFrame:
    """Prompts that ask whether a feature fits a question; features without a name are not asked about."""
    questions = t.nation.select(F.col("n_nationkey").cast("bigint").alias("question_id"), F.col("n_name").alias("question"))
    hits = t.documents.select(
        (F.col("doc_id") % 25).alias("question_id"), F.col("doc_id").alias("feature_id"),
        feature_name("text").alias("feature_name"), feature_description("text").alias("description"),
    )
    return match_prompts(hits, questions)


def _summary_sql() -> str:
    places = {"user_query": "'source ' || s.lang", "retrieved_data": f"coalesce(b.retrieved_data, '{fixed.NO_ROWS_BLOCK}')", "coordinates_section": "''"}
    return f"""
    SELECT s.lang AS question_id, {template_sql(templates.SUMMARISE, places)} AS prompt
    FROM (SELECT DISTINCT lang FROM documents UNION ALL SELECT DISTINCT source FROM documents) s
    LEFT JOIN ({ORACLES['retrieved_block']}) b ON b.lang = s.lang"""


@query(_summary_sql())
def summary_prompt_table(t: Tables) -> DataFrame:
    """Prompts for answers from the rows found; for the sources there are none."""
    names = t.documents.select("lang").distinct().unionAll(t.documents.select("source").distinct())
    questions = names.select(F.col("lang").alias("question_id"), F.concat(F.lit("source "), "lang").alias("question"))
    return summary_prompts(questions, retrieved_block(t).withColumnRenamed("lang", "question_id"))


def _speech_sql() -> str:
    note = "CASE WHEN mapped THEN 'Скажи, что координаты видны на карте.' ELSE '' END"
    places = {"user_query": "'document ' || doc_id", "full_answer": "answer", "map_note": note}
    return f"""
    WITH {ANSWERS_SQL}
    SELECT doc_id AS question_id, {template_sql(templates.SPEECH, places)} AS prompt FROM answers
    WHERE NOT {sql_any("lower(answer)", fixed.NO_DATA_PHRASES)}"""


@query(_speech_sql())
def speech_prompt_table(t: Tables) -> DataFrame:
    """Prompts for texts to read aloud, for answers that hold data."""
    answers = labelled_answers(t).select(
        F.col("doc_id").alias("question_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("question"), "answer",
        F.coalesce("mapped", F.lit(False)).alias("has_coordinates"),
    )
    return speech_prompts(answers)


@query(f"""
    SELECT item_id::VARCHAR AS feature_name, CASE WHEN item_id % 3 = 0 THEN '{fixed.FAILURE_MARKER}try 3' ELSE {sql_strip("text")} END
        AS description, item_id % 3 = 0 AS failed FROM benchmark""")
def failed_descriptions(t: Tables) -> DataFrame:
    """Descriptions after three tries; every third item has failed in all of them."""
    features = t.benchmark.select(F.col("item_id").cast("string").alias("feature_name"), F.lit("text").alias("feature_type"), "item_id")
    tries = t.benchmark.select(F.col("item_id").cast("string").alias("feature_name"), "item_id", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt"))
    good = (F.col("item_id") % 3 == F.col("attempt")) | (F.col("attempt") > 2) & (F.col("item_id") % 3 != 0)
    responses = tries.select(
        "feature_name", "attempt", F.when(good, F.col("text")).alias("text"),
        F.when(~good, F.concat(F.lit("try "), F.col("attempt").cast("string"))).alias("error"),
    )
    described = with_descriptions(features, responses)
    return described.select("feature_name", "description", generation_failed("description").alias("failed"))
