"""Word lists, formats, limits and prices that results depend on."""

# Characters that count as white space when text is trimmed at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Phrases that mark an answer as holding no data.
NO_DATA_PHRASES = (
    "не найдено",
    "не найдены",
    "данных нет",
    "данные не найдены",
    "результатов не найдено",
    "ничего не найдено",
    "к сожалению, по вашему запросу не найдено",
    "не удалось найти",
    "не обнаружено",
    "отсутствуют данные",
    "нет данных",
    "релевантных признаков в базе",
    "ошибка",
)

# Words that mark a line as holding coordinates.
COORDINATE_WORDS = ("📍", "координат", "lon:", "lat:", "долгота", "широта")

# Words that show that an answer already speaks of the map or of coordinates.
MAP_WORDS = ("карт", "координат")
COORDINATE_MENTIONS = ("координат", "📍")

MAP_SENTENCE = " Координаты места можно увидеть на карте."
CUT_SUFFIX = " [текст обрезан из-за ограничений API]"
CUT_LIMIT = 2000
CUT_SHARE = 0.7
SHORT_LINE = 50

# Verdict words.
YES_WORDS = ("ДА", "YES")

# Words in an error text that allow another attempt.
RETRY_WORDS = ("timeout", "handshake")
MAX_ATTEMPTS = 3
FIRST_RETRY_DELAY = 2
FIRST_GENERATION_DELAY = 1
FAILURE_MARKER = "Ошибка генерации: "

# Catalog documents.
NAME_PREFIX = "Признак: "
DESCRIPTION_PREFIX = "Описание: "
NAME_LINES = 3
NAME_LENGTH = 100
DESCRIPTION_LENGTH = 1000
CATALOG_CSV_COLUMNS = ("Название признака", "Тип данных", "Описание")

# Columns shown in a point label, in this order.
LABEL_COLUMNS = ("layer_name", "Регион", "Свита", "Пласт", "matched_feature")
LON_RANGE = (-180.0, 180.0)
LAT_RANGE = (-90.0, 90.0)

# Answers used when a stage has nothing to work on.
NO_HITS_ANSWER = "К сожалению, по вашему запросу не найдено релевантных признаков в базе."
NO_FEATURES_ANSWER = "К сожалению, не найдено признаков, соответствующих вашему запросу."
NO_ROWS_ANSWER = "К сожалению, по вашему запросу данные в базе не найдены."
NO_ROWS_BLOCK = "Данные не найдены в базе."
NO_POINTS_BLOCK = "\n\n⚠️ ВНИМАНИЕ: Координаты не найдены в данных."
POINTS_TITLE = "КООРДИНАТЫ НАЙДЕННЫХ ЗАПИСЕЙ:"
LINES_SHOWN = ("Показаны координаты ", " из ")
BLOCK_ROWS = 50
RULE_WIDTH = 60

# Attempt history.
UNKNOWN_ERROR = "Неизвестная ошибка"
NO_HISTORY = "История ошибок отсутствует"
NO_BINDINGS = "Не указаны"

# Price in roubles of 1000 tokens, by model; the last one is the default.
MODEL_PRICES = {
    "GigaChat-Max": 1.95,
    "GigaChat-Pro": 1.50,
    "GigaChat-2-Pro": 1.50,
    "GigaChat:light": 0.20,
    "GigaChat": 1.50,
}
DEFAULT_MODEL = "GigaChat"

# Usage report.
REPORT_TITLE = "📈 Статистика использования токенов GigaChat API"
REPORT_UPDATED = "Обновлено: "
REPORT_EMPTY = "Статистика пока отсутствует."
REPORT_WIDTH = 53
REPORT_MODEL = "🤖 Модель: "
REPORT_PRICE = "   Цена за 1K токенов: %.2f ₽"
REPORT_REQUESTS = "   Количество запросов: %d"
REPORT_TOKENS = "   Всего токенов: "
REPORT_PROMPT = "     - Входных (prompt): "
REPORT_COMPLETION = "     - Выходных (completion): "
REPORT_MEAN = "   Среднее токенов на запрос: %.1f"
REPORT_MEAN_PROMPT = "     - Входных: %.1f"
REPORT_MEAN_COMPLETION = "     - Выходных: %.1f"
REPORT_COST = "   💰 Общая стоимость: "
REPORT_MEAN_COST = "   💰 Средняя стоимость запроса: "
REPORT_ALL = "📊 ОБЩАЯ СТАТИСТИКА"
REPORT_ALL_REQUESTS = "Всего запросов: %d"
REPORT_ALL_TOKENS = "Всего токенов: "
REPORT_ALL_COST = "💰 Общая стоимость всех тестов: "

# Progress of a request: step names, and the band of per cent of each step.
STEP_NAMES = {
    1: "Генерация описания",
    2: "Поиск в OpenSearch",
    3: "Проверка признаков",
    4: "SQL запросы",
    5: "Формирование ответа",
    6: "Завершено",
}
OTHER_STEP = "Обработка..."
STEP_BANDS = {1: (0, 20), 2: (20, 40), 3: (40, 60), 4: (60, 85), 5: (85, 100)}
CHECK_BAND = (45, 15)
SQL_BAND = (65, 20)
EVICT_SECONDS = 30
DONE_STEP = 6
DONE_MESSAGE = "Запрос выполнен успешно"
FIRST_MESSAGE = "Инициализация..."

# Column catalog.
VECTOR_NAMES = ("embedding", "vector", "vector_field", "embedding_field")
DEFAULT_VECTOR = "embedding"
DEFAULT_TEXT = "text"
VECTOR_DIMENSION = 1024
EMBEDDING_METRIC = "cosinesimil"
KEYWORD_LENGTH = 256
TEXT_TYPE, KEYWORD_TYPE, VECTOR_TYPE = "text", "keyword", "knn_vector"
INDEX_METHOD, INDEX_ENGINE = "hnsw", "nmslib"

# Sizes of top-k.
TOP_K = 10
WEB_TOP_K = 20
PREVIEW_ROWS = 5

# Seconds after which a statement is stopped: the time-out of the usual server settings.
STATEMENT_SECONDS = 120
# Statements that run at a time.
PARALLEL_STATEMENTS = 8
