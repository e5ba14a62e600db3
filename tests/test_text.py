from pyspark.sql import functions as F

from lodestone.functions import fixed, templates, text as X

FENCE = "```"


def test_strip_takes_all_white_space(evaluate):
    assert evaluate(X.strip("c"), [" \t a b　\n", "", None]) == ["a b", "", None]


def test_feature_name(evaluate):
    cells = ["\n  \nПризнак: X\nтекст", "y" * 100 + "\nкоротко", "\n\n\nпоздно", "", "z" * 99]
    assert evaluate(X.feature_name("c"), cells) == ["Признак: X", "коротко", None, None, "z" * 99]


def test_feature_name_prefers_its_fields(evaluate):
    named = X.feature_name("c", F.lit(""), F.lit("name"))
    assert evaluate(named, ["text"]) == ["name"]
    assert evaluate(X.feature_name("c", F.lit("feature"), F.lit("name")), ["text"]) == ["feature"]
    assert evaluate(X.feature_name("c", strip_prefix=True), ["Признак: X"]) == ["X"]


def test_feature_description(evaluate):
    description = X.feature_description("c", F.lit("other"))
    assert evaluate(description, ["a" * 1001, "", None]) == ["a" * 1000, "other", "other"]


def test_verdict(evaluate):
    cells = ["да", "Yes.", "НЕТ", "данных нет", "", None]
    assert evaluate(X.is_yes("c"), cells) == [True, True, False, True, False, False]
    assert evaluate(X.is_yes("c", exact=True), cells) == [True, True, False, False, False, False]


def test_code_fence(evaluate):
    cells = [f"{FENCE}sql\nSELECT 1\n{FENCE}", f"{FENCE}\nSELECT 1 {FENCE}", "SELECT 1", f" {FENCE}SELECT 1\n"]
    assert evaluate(X.strip_code_fence("c"), cells) == ["SELECT 1"] * 4


def test_fence_lines(evaluate):
    cells = [f"{FENCE}text\na\n  {FENCE}\nb", f"a\n{FENCE}\nb"]
    assert evaluate(X.drop_fence_lines("c"), cells) == ["a\nb", f"a\n{FENCE}\nb"]


def test_candidate_names(evaluate):
    cells = ['Binder Error… Candidate bindings: "a", "b c"\n"d"', "no marker", 'Candidate bindings:\n "x"']
    assert evaluate(X.candidate_names("c"), cells) == [["a", "b c"], [], ["x"]]


def test_no_data(evaluate):
    cells = ["Ничего не найдено", "Ошибка сети", "Найдено 3 записи", "ДАННЫХ НЕТ"]
    assert evaluate(X.has_data("c"), cells) == [False, False, True, False]
    assert len(fixed.NO_DATA_PHRASES) == 13


def test_coordinate_lines(evaluate):
    long_line = "1, " + "x" * 50
    cells = [
        "📍 Координаты: …\nтекст",
        "50.1, 40.2\nтекст",
        "Глубина большая, порода плотная",
        long_line,
        "Lat: 5\n  \nДОЛГОТА\n",
        "m², да",
    ]
    kept = ["текст", "текст", "Глубина большая, порода плотная", long_line, "", ""]
    assert evaluate(X.drop_coordinate_lines("c"), cells) == kept


def test_sentence_cut(evaluate):
    def ended(index):
        return "a" * index + ". " + "b" * (2100 - index)

    cells = ["a" * 2000, ended(1500), ended(1400), ended(1401), "a" * 2001, "a" * 1500 + "!\n" + "b" * 600]
    suffix = fixed.CUT_SUFFIX
    assert evaluate(X.cut_at_sentence("c"), cells) == [
        "a" * 2000,
        "a" * 1500 + "." + suffix,
        ended(1400)[:2000] + suffix,
        "a" * 1401 + "." + suffix,
        "a" * 2000 + suffix,
        "a" * 1500 + "!" + suffix,
    ]


def test_map_sentence(evaluate):
    mention = X.ensure_mention("c", F.lit(True))
    assert evaluate(mention, ["Ответ.", "Смотри КАРТУ"]) == ["Ответ." + fixed.MAP_SENTENCE, "Смотри КАРТУ"]
    assert evaluate(X.ensure_mention("c", F.lit(False)), ["Ответ."]) == ["Ответ."]


def test_numbers(evaluate):
    assert evaluate(X.spaced_number("c"), [57878, 999, 1234567], "bigint") == ["57 878", "999", "1 234 567"]
    assert evaluate(X.percent_value("c"), ["1.0%", " 2 % ", "3.5", "x"]) == [1.0, 2.0, 3.5, None]


def test_catalog_text(evaluate):
    assert evaluate(X.catalog_text(F.lit("N"), "c"), ["D"]) == ["Признак: N\nОписание: D"]
    assert evaluate(X.generation_failed("c"), ["Ошибка генерации: x", "x"]) == [True, False]


def test_templates(evaluate):
    filled = templates.fill("{{a}} {x}-{y}", {"x": "c", "y": F.lit(None)})
    assert evaluate(filled, ["v", None]) == ["{a} v-", "{a} -"]
