"""Text operators over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import fixed, templates, text as X
from lodestone.operators.attempts import bindings_text
from lodestone.plans.answer import question_text
from lodestone.queries.registry import Tables, query

WS = f"'{fixed.WHITESPACE}'"
FENCE = "```"


def sql_strip(text: str) -> str:
    return f"trim({text}, {WS})"


def sql_any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def labelled_answers(t: Tables) -> DataFrame:
    """Documents as answers; those with a label get a sentence that depends on it."""
    labels = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    note = (
        F.when(F.col("toxic") == 1, "\nК сожалению, НИЧЕГО не найдено.")
        .when(F.col("quality") == 1, "\n📍 Координаты: 50.1, 40.2\nДолгота 50.1")
        .otherwise("")
    )
    return t.documents.join(labels, "doc_id", "left").select(
        "doc_id", F.concat("text", F.coalesce(note, F.lit(""))).alias("answer"), (F.col("quality") == 1).alias("mapped")
    )


ANSWERS_SQL = """
    l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
    answers AS (SELECT d.doc_id, d.text || CASE WHEN toxic = 1 THEN chr(10) || 'К сожалению, НИЧЕГО не найдено.'
        WHEN quality = 1 THEN chr(10) || '📍 Координаты: 50.1, 40.2' || chr(10) || 'Долгота 50.1' ELSE '' END AS answer,
        quality = 1 AS mapped FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id)"""


@query(f"""
    WITH {ANSWERS_SQL}
    SELECT doc_id, NOT {sql_any("lower(answer)", fixed.NO_DATA_PHRASES)} AS has_data FROM answers""")
def no_data_filter(t: Tables) -> DataFrame:
    """Whether an answer holds data."""
    return labelled_answers(t).select("doc_id", X.has_data("answer").alias("has_data"))


@query(f"""
    WITH {ANSWERS_SQL}
    SELECT doc_id, {sql_strip(f'''array_to_string(list_filter(string_split(answer, chr(10)), lambda x:
        NOT {sql_any("lower(x)", fixed.COORDINATE_WORDS)}
        AND NOT (contains(x, ',') AND regexp_matches(x, '{X.DIGIT}') AND length({sql_strip("x")}) < 50)), chr(10))''')}
        AS cleaned FROM answers""")
def line_clean(t: Tables) -> DataFrame:
    """Answers without lines of coordinates."""
    return labelled_answers(t).select("doc_id", X.drop_coordinate_lines("answer").alias("cleaned"))


@query(f"""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 2000) AS head FROM documents),
    s AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])[ \\n]', 1) AS ended FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text
        WHEN length(ended) - 1 > 1400 THEN ended || '{fixed.CUT_SUFFIX}'
        ELSE head || '{fixed.CUT_SUFFIX}' END AS spoken FROM s""")
def sentence_cut(t: Tables) -> DataFrame:
    """Texts cut at a sentence end."""
    return t.documents.select("doc_id", X.cut_at_sentence("text").alias("spoken"))


@query(f"""
    WITH {ANSWERS_SQL}
    SELECT doc_id, CASE WHEN coalesce(mapped, false) AND NOT {sql_any("lower(answer)", ("schön", *fixed.MAP_WORDS[:1]))}
        THEN answer || '{fixed.MAP_SENTENCE}' ELSE answer END AS spoken FROM answers""")
def ensure_mention(t: Tables) -> DataFrame:
    """The map sentence where an answer has points and no map word."""
    wanted = F.coalesce("mapped", F.lit(False))
    words = ("schön", *fixed.MAP_WORDS[:1])
    return labelled_answers(t).select("doc_id", X.ensure_mention("answer", wanted, words=words).alias("spoken"))


def _fenced(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit(f" {FENCE}sql\n"), text, F.lit(f"\n{FENCE}\n")))
        .when(role == "assistant", F.concat(F.lit(f"{FENCE}\n"), text))
        .otherwise(text)
    )


FENCED_SQL = f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN ' {FENCE}sql' || chr(10) || text || chr(10) || '{FENCE}' || chr(10)
    WHEN 'assistant' THEN '{FENCE}' || chr(10) || text ELSE text END AS t FROM conversations"""


@query(f"""
    WITH f AS ({FENCED_SQL}), s AS (SELECT conv_id, turn, {sql_strip("t")} AS t FROM f)
    SELECT conv_id, turn,
        {sql_strip(f"regexp_replace(regexp_replace(regexp_replace(t, '^{FENCE}sql', ''), '^{FENCE}', ''), '{FENCE}$', '')")}
        AS statement,
        CASE WHEN starts_with(t, '{FENCE}') THEN {sql_strip(f'''array_to_string(list_filter(string_split(t, chr(10)),
            lambda x: NOT starts_with({sql_strip("x")}, '{FENCE}')), chr(10))''')} ELSE t END AS lines
    FROM s""")
def fence_clean(t: Tables) -> DataFrame:
    """Responses without their code fence, in the statement form and the line form."""
    fenced = t.conversations.withColumn("text", _fenced(F.col("role"), F.col("text")))
    return fenced.select(
        "conv_id", "turn", X.strip_code_fence("text").alias("statement"), X.drop_fence_lines("text").alias("lines")
    )


@query(f"""
    WITH n AS (SELECT doc_id, substr(text, 1, {fixed.DESCRIPTION_LENGTH}) AS description,
        list_filter(list_transform(string_split(text, chr(10))[1:3], lambda x: {sql_strip("x")}),
                    lambda x: x <> '' AND length(x) < 100)[1] AS feature_name FROM documents)
    SELECT doc_id, feature_name, description FROM n WHERE feature_name <> ''""")
def feature_names(t: Tables) -> DataFrame:
    """Name and description of documents as catalog entries; without a name there is no entry."""
    named = t.documents.select(
        "doc_id", X.feature_name("text").alias("feature_name"), X.feature_description("text").alias("description")
    )
    return named.where(F.col("feature_name") != "")


def template_sql(template: str, places: dict[str, str]) -> str:
    """The template as a SQL concatenation."""
    parts = template.replace("'", "''")
    for name, expression in places.items():
        parts = parts.replace("{" + name + "}", f"' || coalesce({expression}::VARCHAR, '') || '")
    return f"'{parts}'"


@query(f"""
    WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
    SELECT d.doc_id, {template_sql(templates.MATCH_FEATURE, {"user_query": "d.source", "feature_name": "l.quality",
                                                             "feature_description": "d.text"})} AS prompt
    FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def prompt_table(t: Tables) -> DataFrame:
    """Prompts from a template; a missing value fills as empty text."""
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    places = {"user_query": "source", "feature_name": "quality", "feature_description": "text"}
    joined = t.documents.join(quality, "doc_id", "left")
    return joined.select("doc_id", templates.fill(templates.MATCH_FEATURE, places).alias("prompt"))


@query(f"""
    WITH a AS (SELECT conv_id, turn, text AS response FROM conversations WHERE role = 'assistant')
    SELECT u.conv_id, u.turn, coalesce(nullif({sql_strip("a.response")}, ''), u.text) AS search_text
    FROM conversations u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'""")
def described_questions(t: Tables) -> DataFrame:
    """Each user turn with the response to it, else the turn itself."""
    turns = t.conversations
    question = F.struct("conv_id", "turn").alias("question_id")
    questions = turns.where("role = 'user'").select(question, F.col("text").alias("question"))
    answered = F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("question_id")
    responses = turns.where("role = 'assistant'").select(answered, "text")
    return question_text(questions, responses).select("question_id.*", "search_text")


@query(f"""
    SELECT conv_id, turn, role, text FROM conversations
    WHERE contains(upper({sql_strip("text")}), 'THE') OR contains(upper({sql_strip("text")}), 'ÉT')""")
def verdict_filter(t: Tables) -> DataFrame:
    """Turns whose text counts as a yes, with other yes words than the usual ones."""
    return t.conversations.where(X.is_yes("text", words=("THE", "ÉT")))


@query(f"""
    SELECT item_id::VARCHAR AS _id,
           '{fixed.NAME_PREFIX}' || item_id || chr(10) || '{fixed.DESCRIPTION_PREFIX}' || text AS text
    FROM benchmark""")
def catalog_texts(t: Tables) -> DataFrame:
    """Text of catalog documents."""
    number = F.col("item_id").cast("string")
    return t.benchmark.select(number.alias("_id"), X.catalog_text(number, "text").alias("text"))


@query("""
    WITH n AS (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1)
    SELECT source, replace(format('{:,}', n), ',', ' ') AS characters FROM n""")
def spaced_numbers(t: Tables) -> DataFrame:
    """Whole numbers with thousands set apart."""
    sums = t.documents.groupBy("source").agg(F.sum("n_chars").alias("n"))
    return sums.select("source", X.spaced_number("n").alias("characters"))


@query("""
    WITH m AS (SELECT event_id, 'Binder Error: no column' || chr(10) || 'Candidate bindings: "' || event_type
        || '", "user ' || user_id || '"' || chr(10) || 'LINE 1: "' || value || '"' AS message FROM events),
    c AS (SELECT event_id, regexp_extract_all(regexp_extract(message, 'Candidate bindings:\\s*([^\\n]+)', 1),
        '"([^"]+)"', 1) AS names FROM m)
    SELECT event_id, array_to_string(list_sort(list_distinct(names)), '|') AS names,
           '- `' || array_to_string(list_sort(list_distinct(names)), '`' || chr(10) || '- `') || '`' AS listed FROM c""")
def candidate_bindings(t: Tables) -> DataFrame:
    """Column names that an error message suggests."""
    message = F.concat(
        F.lit('Binder Error: no column\nCandidate bindings: "'), "event_type", F.lit('", "user '),
        F.col("user_id").cast("string"), F.lit('"\nLINE 1: "'), F.col("value").cast("string"), F.lit('"'),
    )
    names = F.array_sort(F.array_distinct(X.candidate_names(message)))
    return t.events.select(
        "event_id", F.array_join(names, "|").alias("names"), bindings_text(names).alias("listed")
    )
