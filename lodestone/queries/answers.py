"""Whole runs: questions to answers, and the catalog build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions import fixed, templates
from lodestone.operators.profile import column_profile, profile_text
from lodestone.plans.answer import Answers, answer_questions as run_questions, find_hits
from lodestone.plans.catalog import build_catalog, catalog_prompts, embed
from lodestone.plans.prompts import speech_text, sql_prompts
from lodestone.queries.points import records
from lodestone.queries.registry import Tables, query
from lodestone.queries.texts import ANSWERS_SQL as LABELLED_SQL, sql_any, sql_strip, template_sql, labelled_answers
from lodestone.queries.vectors import CENTROID_SQL, centroids
from lodestone.session import kept, read_table, shared_dir

# SQL that the catalog entry's language stands for. The first French text has a wrong name; of the Spanish ones the first is
# no query, the second fails when it runs, and the third has names that others use too, one of them twice.
STATEMENTS = {
    "en": [
        '```sql\nSELECT "key", "lon", "lat", "layer_name" FROM df WHERE "c_acctbal" > 0 AND "c_acctbal" < 150 ORDER BY "key"\n```'
    ],
    "fr": ['SELECT "acctbal" FROM df', 'SELECT "key", "lon", "lat" FROM df WHERE "c_acctbal" < 0 ORDER BY "key"'],
    "de": ['SELECT MAX("c_acctbal") AS top, "nation" FROM df WHERE "c_acctbal" IS NOT NULL GROUP BY "nation" ORDER BY "nation"'],
    "es": [
        "DROP TABLE df",
        'SELECT "layer_name" + 5 AS x FROM df WHERE "layer_name" IS NOT NULL',
        'SELECT c_acctbal AS rank, "nation" AS feature_name, "key" AS feature_name FROM df ORDER BY c_acctbal DESC, "key" LIMIT 3',
    ],
}


# Pairs of numbers that no cluster ends counting.
ENDLESS = "SELECT count(*) AS n FROM range(100000000) a JOIN range(100000000) b ON a.id % 7 <> b.id % 5"


def _answers(t: Tables, summarised: bool = False, first: dict[str, str] | None = None, seconds: float | None = None) -> Answers:
    """A question per label; the catalog is the documents that have a vector.

    With `summarised` every question has a model's text, and there is one more, without a vector, that finds nothing. `first`: texts by
    language that are tried before the others. `seconds`: time limit of a statement.
    """
    questions = centroids(t.embeddings).select(
        F.col("label").alias("question_id"), F.concat(F.lit("label "), "label").alias("question"), "embedding"
    )
    summaries = None
    if summarised:
        none = questions.agg((F.max("question_id") + 1).alias("question_id")).select(
            "question_id", F.concat(F.lit("label "), "question_id").alias("question"), F.array().cast("array<double>").alias("embedding")
        )
        questions = questions.unionByName(none)
        summaries = questions.select("question_id", F.concat(F.lit(" Итог "), F.col("question_id").cast("string"), F.lit(". ")).alias("text"))
    documents = t.documents.select("doc_id", "lang", "text")
    catalog = t.embeddings.join(documents, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("_id"), "text", "lang", "embedding"
    )
    hits = find_hits(questions, catalog)
    # The responses to the prompts about the hits: the quality of a document is its verdict, after one
    # time-out for the toxic ones, and its language picks the SQL.
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    asked = hits.select("question_id", "feature_id").join(labels, F.col("feature_id") == F.col("doc_id"))
    yes = F.when(F.col("quality") == 1, "да.").otherwise("нет")
    tries = F.when(F.col("toxic") == 1, F.array(F.lit(None).cast("string"), yes)).otherwise(F.array(yes))
    verdicts = asked.select("question_id", "feature_id", F.posexplode(tries).alias("at", "text")).select(
        "question_id",
        "feature_id",
        (F.col("at") + 1).alias("attempt"),
        "text",
        F.when(F.col("text").isNull(), "read timeout").alias("error"),
    )
    ladders = {lang: [*([first[lang]] if first and lang in first else []), *some] for lang, some in STATEMENTS.items()}
    texts = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in ladders.items() for x in pair])
    spoken = hits.select("question_id", "feature_id").join(documents, F.col("feature_id") == F.col("doc_id"))
    statements = spoken.select("question_id", "feature_id", F.posexplode(texts[F.col("lang")]).alias("at", "sql"))
    statements = statements.withColumn("attempt", F.col("at") + 1).drop("at")
    return run_questions(
        t.spark, questions, hits, verdicts, statements,
        lambda session: records(read_table(session, t.directory, "customer")), summaries,
        **({} if seconds is None else {"statement_seconds": seconds}),
    )


CATALOG_JOIN = "FROM q, (SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) e"
ANSWERS_SQL = f"""
    WITH hits AS ({CENTROID_SQL.replace("FROM q, embeddings e", CATALOG_JOIN)}),
    l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
    f AS (SELECT h.label, h.vec_id, d.lang FROM hits h JOIN l ON l.doc_id = h.vec_id JOIN documents d ON d.doc_id = h.vec_id
        WHERE l.quality = 1 AND list_filter(list_transform(string_split(d.text, chr(10))[1:3], lambda x: trim(x)),
            lambda x: x <> '' AND length(x) < 100)[1] <> ''),
    rows AS (
        SELECT 'en' AS lang, c_custkey AS key, c_acctbal AS x, c_nationkey * 4 AS y, c_mktsegment AS seg FROM customer
            WHERE c_acctbal > 0 AND c_acctbal < 150
        UNION ALL SELECT 'fr', c_custkey, c_acctbal, c_nationkey * 4, c_mktsegment FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'de', NULL, NULL, NULL, NULL FROM customer GROUP BY c_nationkey
        UNION ALL SELECT 'es', NULL, NULL, NULL, NULL FROM (FROM customer LIMIT 3)),
    a AS (SELECT f.label, count(*) AS n, count(*) FILTER (x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND
            seg IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')) AS points FROM f JOIN rows USING (lang) GROUP BY 1)
    SELECT q.label AS question_id, 'label ' || q.label AS question,
        CASE WHEN fc.n IS NULL THEN 'no_features' ELSE 'answered' END AS status, coalesce(fc.n, 0) AS features,
        coalesce(a.n, 0) AS results_count, coalesce(a.points, 0) AS points, coalesce(a.points, 0) > 0 AS has_coordinates
    FROM (SELECT DISTINCT label FROM hits) q LEFT JOIN (SELECT label, count(*) AS n FROM f GROUP BY 1) fc USING (label)
    LEFT JOIN a USING (label)"""


@query(ANSWERS_SQL)
def answer_questions(t: Tables) -> DataFrame:
    """Status and counts of every answered question."""
    return _answers(t).answers.drop("answer")


@query(ANSWERS_SQL)
def answer_time_limit(t: Tables) -> DataFrame:
    """The same answers when the first statement about every German entry never ends: it is stopped, and the next one is tried."""
    return _answers(t, first={"de": ENDLESS}, seconds=12).answers.drop("answer")


def _cells(row: bool) -> str:
    """Header or line of the block: only columns of statements that were accepted."""
    names = [
        ["key", "lon", "lat"], ["layer_name"], ["top", "nation"], ["rank", "feature_name", "feature_name_2"], ["matched_feature"],
    ]
    shown = ["any_point", "any_en", "any_de", "any_es", "true"]
    parts = []
    for group, condition in zip(names, shown):
        cells = [f"coalesce({n}::VARCHAR, '')" if row else f"'{n}'" for n in group]
        parts.append(f"CASE WHEN {condition} THEN [{', '.join(cells)}] ELSE [] END")
    return f"array_to_string({' || '.join(parts)}, ' | ')"


RULE = "=" * fixed.RULE_WIDTH
TEXTS_SQL = f"""
    WITH hits AS ({CENTROID_SQL.replace("FROM q, embeddings e", CATALOG_JOIN)}),
    l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
    n AS (SELECT h.label, h.rank AS feature_rank, d.lang, list_filter(list_transform(string_split(d.text, chr(10))[1:3],
            lambda x: trim(x)), lambda x: x <> '' AND length(x) < 100)[1] AS matched_feature
        FROM hits h JOIN l ON l.doc_id = h.vec_id JOIN documents d ON d.doc_id = h.vec_id WHERE l.quality = 1),
    f AS (SELECT *, bool_or(lang IN ('en', 'fr')) OVER () AS any_point, bool_or(lang = 'en') OVER () AS any_en,
            bool_or(lang = 'de') OVER () AS any_de, bool_or(lang = 'es') OVER () AS any_es FROM n WHERE matched_feature <> ''),
    r AS (SELECT c_custkey AS key, c_acctbal AS acc, c_nationkey AS home, c_mktsegment AS seg,
            CASE WHEN c_nationkey > 5 THEN c_mktsegment END AS layer, c_acctbal::VARCHAR AS x, (c_nationkey * 4)::VARCHAR AS y
        FROM customer),
    p AS (SELECT *, CASE seg WHEN 'BUILDING' THEN ' ' || x || chr(9) WHEN 'AUTOMOBILE' THEN '[' || x || ', ' || y || ']'
            WHEN 'MACHINERY' THEN '[''' || x || ''',''' || y || ''']' WHEN 'HOUSEHOLD' THEN '[' || x || ',1, ' || y
            ELSE '[''' || y || ',5'', ''' || x || ',5'']' END AS lon,
        CASE seg WHEN 'BUILDING' THEN ' ' || y || chr(9) WHEN 'AUTOMOBILE' THEN '[' || x || ', ' || y || ']'
            WHEN 'MACHINERY' THEN '[''' || x || ''',''' || y || ''']' WHEN 'HOUSEHOLD' THEN '[' || x || ',1, ' || y
            ELSE '[''' || y || ',5'', ''' || x || ',5'']' END AS lat,
        CASE WHEN seg = 'FURNITURE' THEN y || ',5, Широта: ' || x || ',5' ELSE x || ', Широта: ' || y END AS place FROM r),
    rows AS (SELECT 'en' AS lang, key, lon, lat, layer AS layer_name, NULL::DOUBLE AS top, NULL::INTEGER AS nation,
                NULL::DOUBLE AS rank, NULL::INTEGER AS feature_name, NULL::BIGINT AS feature_name_2, place, key AS turn
            FROM p WHERE acc > 0 AND acc < 150
        UNION ALL SELECT 'fr', key, lon, lat, NULL, NULL, NULL, NULL, NULL, NULL, place, key FROM p WHERE acc < 0
        UNION ALL SELECT 'de', NULL, NULL, NULL, NULL, max(acc), home, NULL, NULL, NULL, NULL, home FROM p GROUP BY home
        UNION ALL SELECT 'es', NULL, NULL, NULL, NULL, NULL, NULL, acc, home, key, NULL, n FROM
            (SELECT *, row_number() OVER (ORDER BY acc DESC, key) AS n FROM p) WHERE n <= 3),
    t AS (SELECT label, feature_rank, place, turn, {_cells(row=True)} AS line, {_cells(row=False)} AS header
        FROM f JOIN rows USING (lang)),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY feature_rank, turn) AS n,
            count(*) OVER (PARTITION BY label) AS total, count(place) OVER (PARTITION BY label) AS places FROM t),
    pl AS (SELECT label, n, 'Запись ' || n || ': Долгота: ' || place AS line, places,
            row_number() OVER (PARTITION BY label ORDER BY n) AS k FROM o WHERE place IS NOT NULL),
    pt AS (SELECT label, string_agg(line, chr(10) ORDER BY n) || CASE WHEN places > 50
            THEN chr(10) || '{fixed.LINES_SHOWN[0]}50{fixed.LINES_SHOWN[1]}' || places ELSE '' END AS points
        FROM pl WHERE k <= 50 GROUP BY label, places),
    b AS (SELECT label, total, CASE WHEN total > 50 THEN 'Найдено ' || total || ' записей. Показаны первые 50:' || chr(10)
            || chr(10) ELSE '' END || header || chr(10) || string_agg(line, chr(10) ORDER BY n) AS block, points
        FROM o LEFT JOIN pt USING (label) WHERE n <= 50 GROUP BY label, total, header, points)
    SELECT q.label AS question_id, CASE WHEN q.label NOT IN (SELECT label FROM f) THEN '{fixed.NO_FEATURES_ANSWER}'
        WHEN b.label IS NULL THEN '{fixed.NO_ROWS_ANSWER}'
        ELSE 'Найдено ' || total || ' записей:' || chr(10) || chr(10) || block || CASE WHEN points IS NULL
            THEN '{fixed.NO_POINTS_BLOCK}' ELSE chr(10) || chr(10) || '{RULE}' || chr(10) || '{fixed.POINTS_TITLE}'
            || chr(10) || '{RULE}' || chr(10) || points || chr(10) || '{RULE}' END END AS answer
    FROM (SELECT DISTINCT label FROM hits) q LEFT JOIN b USING (label)"""


@query(TEXTS_SQL)
def answer_texts(t: Tables) -> DataFrame:
    """The answers' texts."""
    return _answers(t).answers.select("question_id", "answer")


@query(TEXTS_SQL[: TEXTS_SQL.index("    pt AS (")].rstrip().rstrip(",") + " SELECT label AS question_id, n AS position, line FROM pl")
def answer_lines(t: Tables) -> DataFrame:
    """All coordinate lines of all answers, also of those whose text shows the first ones only."""
    lines = _answers(t).lines
    if lines is None:
        lines = t.spark.createDataFrame([], "question_id int, position long, line string")
    return lines.select("question_id", "position", "line")


@query(TEXTS_SQL[: TEXTS_SQL.index("    b AS (SELECT label, total")].rstrip().rstrip(",") + f"""
    SELECT q.label AS question_id, CASE WHEN f.label IS NULL THEN 'no_features' ELSE 'answered' END AS status,
        CASE WHEN f.label IS NULL THEN '{fixed.NO_FEATURES_ANSWER}' ELSE 'Итог ' || q.label || '.' || CASE WHEN points IS NULL THEN ''
            ELSE chr(10) || chr(10) || '📍 {fixed.POINTS_TITLE}' || chr(10) || replace(points, 'Запись ', '• ') END END AS answer
    FROM (SELECT DISTINCT label FROM hits) q LEFT JOIN (SELECT DISTINCT label FROM f) f USING (label) LEFT JOIN pt USING (label)
    UNION ALL SELECT max(label) + 1, 'no_hits', '{fixed.NO_HITS_ANSWER}' FROM embeddings""")
def answer_summaries(t: Tables) -> DataFrame:
    """Answers with a model's text, to which the points are added; and a question without hits."""
    return _answers(t, summarised=True).answers.select("question_id", "status", "answer")


@query(TEXTS_SQL[: TEXTS_SQL.index("    r AS (SELECT c_custkey")].rstrip().rstrip(",") + f""",
    e(lang, sql, error_class) AS (VALUES ('es', '{STATEMENTS["es"][0]}', 'PARSE_SYNTAX_ERROR'),
        ('es', '{STATEMENTS["es"][1]}', 'CAST_INVALID_INPUT'), ('fr', '{STATEMENTS["fr"][0]}', 'UNRESOLVED_COLUMN.WITH_SUGGESTION'))
    SELECT sql, error_class FROM e WHERE lang IN (SELECT lang FROM f)""")
def failed_statements(t: Tables) -> DataFrame:
    """The statements that failed, by analysis or when they ran, with the class of their error."""
    return _answers(t).outcomes.where("not ok").select("sql", "error_class")


@query("""
    WITH w AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
    n AS (SELECT b.item_id, b.text, e.embedding, quality, row_number() OVER (ORDER BY b.item_id) - 1 AS n
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id LEFT JOIN w ON w.doc_id = b.item_id)
    SELECT n::VARCHAR AS _id, 'Признак: ' || lpad(item_id::VARCHAR, 12, '0') || chr(10) || 'Описание: '
        || trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text, len(embedding)::BIGINT AS dimension
    FROM n WHERE coalesce(quality, 0) = 0""")
def catalog_build(t: Tables) -> DataFrame:
    """Catalog of the benchmark items: prompts, descriptions, vectors, stored documents.

    Items whose document has good quality are already done; the numbering counts them all the same.
    """
    features, responses, vectors = _catalog_parts(t)
    finished = t.labels.where("quality = 1").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("feature_name")
    )
    path = shared_dir(t.spark, "catalog")
    load = build_catalog(features, responses, vectors, path, finished)
    if not load.complete:
        raise RuntimeError("the load is not whole")
    return _stored_catalog(t, path)


def _stored_catalog(t: Tables, path: str) -> DataFrame:
    stored = t.spark.read.parquet(path)
    return stored.select("_id", "text", F.size("embedding").cast("bigint").alias("dimension"))


@query("""
    WITH n AS (SELECT b.item_id, b.text, e.embedding, row_number() OVER (ORDER BY b.item_id) - 1 AS n
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)
    SELECT n::VARCHAR AS _id, 'Признак: ' || lpad(item_id::VARCHAR, 12, '0') || chr(10) || 'Описание: '
        || trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text, len(embedding)::BIGINT AS dimension
    FROM n""")
def catalog_resume(t: Tables) -> DataFrame:
    """A build that was broken off and taken up again at the same path is the whole catalog.

    In the first run every other item has no response; the second takes what the first has stored as finished.
    """
    features, responses, vectors = _catalog_parts(t)
    path = shared_dir(t.spark, "catalog")
    half = responses.where(F.col("feature_name").cast("bigint") % 2 == 0)
    build_catalog(features, half, vectors, path)
    stored = t.spark.read.parquet(path).select(F.regexp_extract("text", r"Признак: (\d+)", 1).alias("feature_name"))
    load = build_catalog(features, responses, vectors, path, kept(stored, "finished"))
    if not load.complete:
        raise RuntimeError("the load is not whole")
    return _stored_catalog(t, path)


def _catalog_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, responses and vectors of the benchmark items."""
    name = F.lpad(F.col("item_id").cast("string"), 12, "0").alias("feature_name")
    features = catalog_prompts(t.benchmark.select(name, F.lit("text (keyword)").alias("feature_type"), "item_id"))
    responses = t.benchmark.select(
        name, F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.col("text").alias("_t")
    ).select(
        "feature_name",
        "attempt",
        F.when(F.col("attempt") == 2, F.col("_t")).alias("text"),
        F.when(F.col("attempt") == 1, "timeout").alias("error"),
    )
    vectors = t.embeddings.select(
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("feature_name"), "embedding"
    )
    return features, responses, vectors


@query(f"""
    WITH {LABELLED_SQL},
    r AS (SELECT a.*, '```' || chr(10) || b.text || chr(10) || '```' AS response
        FROM answers a LEFT JOIN benchmark b ON b.item_id = a.doc_id),
    c AS (SELECT doc_id, answer, mapped, coalesce({sql_strip(f'''array_to_string(list_filter(string_split(
        {sql_strip("response")}, chr(10)), lambda x: NOT starts_with({sql_strip("x")}, '```')), chr(10))''')},
        {sql_strip(f'''array_to_string(list_filter(string_split(answer, chr(10)), lambda x:
        NOT {sql_any("lower(x)", fixed.COORDINATE_WORDS)} AND NOT (contains(x, ',') AND regexp_matches(x, '[0-9]')
        AND length({sql_strip("x")}) < 50)), chr(10))''')}) AS t FROM r),
    m AS (SELECT doc_id, answer, CASE WHEN coalesce(mapped, false) AND NOT {sql_any("lower(t)", fixed.MAP_WORDS)}
        THEN t || '{fixed.MAP_SENTENCE}' ELSE t END AS t FROM c),
    e AS (SELECT doc_id, answer, t, regexp_extract(substr(t, 1, 2000), '(?s)^(.*[.!?])[ \\n]', 1) AS ended FROM m)
    SELECT doc_id, CASE WHEN {sql_any("lower(answer)", fixed.NO_DATA_PHRASES)} THEN NULL
        WHEN length(t) <= 2000 THEN t WHEN length(ended) - 1 > 1400 THEN ended || '{fixed.CUT_SUFFIX}'
        ELSE substr(t, 1, 2000) || '{fixed.CUT_SUFFIX}' END AS spoken FROM e""")
def speech_texts(t: Tables) -> DataFrame:
    """Texts to read aloud: the model's where there is one, else the cleaned answer."""
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n```")).alias("response")
    responses = t.benchmark.select(F.col("item_id").alias("doc_id"), fenced)
    answers = labelled_answers(t).join(responses, "doc_id", "left")
    spoken = speech_text(F.col("answer"), F.col("mapped"), F.col("response"))
    return answers.select("doc_id", spoken.alias("spoken"))


@query("""
    SELECT doc_id, length(text)::DOUBLE AS characters, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks
    FROM documents""")
def embedded_texts(t: Tables) -> DataFrame:
    """Vectors from a function of the caller; here a vector holds the length and the blanks of a text."""
    vectors = embed(t.documents, "text", lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts])
    at = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select("doc_id", at[0].alias("characters"), at[1].alias("blanks"))


PART_COLUMNS = (
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"),
)
PART_FILLS = " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS c, '{d}' AS d, count({c}) AS f, count(*) AS n FROM part" for i, (c, d) in enumerate(PART_COLUMNS)
)
PROFILE_SQL = f"""(SELECT string_agg('- `' || c || '` (' || d || ', заполнено: ' || f || '/' || n || ')', chr(10) ORDER BY i)
    FROM ({PART_FILLS}))"""


@query(f"""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS attempt FROM events),
    l AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS won,
        arg_max(event_id, attempt) AS last_id, string_agg('Попытка ' || attempt || ': ' || event_type || chr(10)
            || 'Доступные колонки: ' || event_type, chr(10) ORDER BY attempt) AS history,
        list_sort(list(DISTINCT event_type)) AS names, arg_max(event_type, attempt) AS last_type
        FROM e WHERE attempt <= 3 GROUP BY ALL),
    p AS (SELECT *, {PROFILE_SQL} AS info, '- `' || array_to_string(names, '`' || chr(10) || '- `') || '`' AS listed FROM l
        WHERE won = 0 AND n < 3)
    SELECT user_id AS question_id, day AS feature_id, n + 1 AS attempt, CASE n
        WHEN 1 THEN {template_sql(templates.FIX_SQL, {
            "user_query": "'user ' || user_id", "feature_name": "day", "feature_description": "'events'", "columns_info": "info",
            "sql_query": "'SELECT ' || last_id", "error_message": "last_type", "candidate_bindings": "listed"})}
        ELSE {template_sql(templates.FIX_SQL_WITH_HISTORY, {
            "user_query": "'user ' || user_id", "feature_name": "day", "feature_description": "'events'", "columns_info": "info",
            "sql_query": "'SELECT ' || last_id", "error_message": "last_type", "candidate_bindings": "listed",
            "error_history": "history"})} END AS prompt
    FROM p""")
def next_sql_prompts(t: Tables) -> DataFrame:
    """The next prompt for SQL after one or two failed attempts: users are questions, their days features."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("feature_id")
    log = t.events.select("*", day)
    in_turn = Window.partitionBy("user_id", "feature_id").orderBy("ts", "event_id")
    tries = log.withColumn("_rank", F.row_number().over(in_turn))
    attempts = tries.select(
        F.col("user_id").alias("question_id"),
        "feature_id",
        F.col("_rank").alias("attempt"),
        F.concat(F.lit("SELECT "), F.col("event_id").cast("string")).alias("sql"),
        (F.col("event_type") == "purchase").alias("ok"),
        F.col("event_type").alias("error"),
        F.array("event_type").alias("bindings"),
    )
    features = t.events.select(F.col("user_id").alias("question_id"), day).distinct()
    features = features.withColumns(
        {"feature_name": F.col("feature_id"), "description": F.lit("events")}
    )
    questions = t.events.select(F.col("user_id").alias("question_id")).distinct()
    questions = questions.withColumn("question", F.concat(F.lit("user "), F.col("question_id").cast("string")))
    info = profile_text(column_profile(t.part))
    return sql_prompts(features, questions, info, attempts).withColumn("attempt", F.col("attempt").cast("bigint"))
