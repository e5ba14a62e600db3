"""Prompt columns from templates with named places.

A template is split once on the driver, so each row only concatenates literals and columns.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Default wording of the prompts; any other text with the same places may be passed instead.
DESCRIBE_QUESTION = (
    "Опиши признак или данные, о которых спрашивает пользователь.\n"
    "Вопрос: {user_query}\nОтветь только описанием."
)
DESCRIBE_FEATURE = (
    "Опиши признак таблицы записей.\nНазвание: {feature_name}\nТип: {feature_type}\n"
    "Укажи смысл, единицы и обычные значения."
)
MATCH_FEATURE = (
    "Вопрос: {user_query}\nПризнак: {feature_name}\nОписание признака: {feature_description}\n"
    "Подходит ли признак к вопросу? Ответь одним словом: ДА или НЕТ."
)
WRITE_SQL = (
    "Вопрос: {user_query}\nПризнак: {feature_name}\nОписание: {feature_description}\n"
    "Колонки таблицы df:\n{columns_info}\nНапиши один запрос SELECT к таблице df."
)
FIX_SQL = WRITE_SQL + (
    "\nПрошлый запрос:\n{sql_query}\nОшибка:\n{error_message}\nПодходящие колонки:\n{candidate_bindings}"
)
FIX_SQL_WITH_HISTORY = FIX_SQL + "\nВсе прошлые ошибки:\n{error_history}"
SUMMARISE = (
    "Вопрос: {user_query}\nНайденные записи:\n{retrieved_data}\n{coordinates_section}\n"
    "Дай ответ на вопрос по этим записям и приведи координаты."
)
SPEECH = (
    "Вопрос: {user_query}\nОтвет:\n{full_answer}\n{map_note}\n"
    "Перескажи ответ коротко, для чтения вслух."
)

SQL_TEMPLATES = {1: WRITE_SQL, 2: FIX_SQL, 3: FIX_SQL_WITH_HISTORY}


def fill(template: str, values: Mapping[str, Column | str]) -> Column:
    """The template with each `{place}` replaced by its column; a null fills as empty text."""
    parts = []
    for literal, place, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if place is not None:
            if place not in values:
                raise KeyError(f"template place without a column: {place}")
            value = values[place]
            column = F.col(value) if isinstance(value, str) else value
            parts.append(F.coalesce(column.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
