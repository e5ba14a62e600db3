"""Text expressions: clean-up, cutting, catalog names and verdicts. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lodestone.functions import fixed
from lodestone.functions.binding import bind

FENCE = "```"
# Decimal digits of any script, and raised or lowered ones.
DIGIT = r"[\p{Nd}⁰¹²³⁴-⁹₀-₉]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(text), F.lit(fixed.WHITESPACE))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(F.lit(word))
    return found


def has_data(answer: Column | str, phrases: Sequence[str] = fixed.NO_DATA_PHRASES) -> Column:
    """False when the lower-cased answer holds one of the no-data phrases."""
    return bind(F.lower(_col(answer)), lambda lowered: ~contains_any(lowered, phrases))


def drop_coordinate_lines(text: Column | str, words: Sequence[str] = fixed.COORDINATE_WORDS) -> Column:
    """Drop lines that name coordinates, and short lines with a comma and a digit."""

    def kept(line: Column, lowered: Column) -> Column:
        named = contains_any(lowered, words)
        # The cheap conditions go first.
        bare = (F.length(strip(line)) < fixed.SHORT_LINE) & line.contains(",") & line.rlike(DIGIT)
        return F.when(~named & ~bare, line)

    def lines_left(text: Column) -> Column:
        # Lower case is found for the whole text at once; a joined array leaves its nulls out.
        lines = F.zip_with(F.split(text, "\n"), F.split(F.lower(text), "\n"), kept)
        return strip(F.array_join(lines, "\n"))

    return bind(_col(text), lines_left)


def cut_at_sentence(
    text: Column | str,
    limit: int = fixed.CUT_LIMIT,
    share: float = fixed.CUT_SHARE,
    suffix: str = fixed.CUT_SUFFIX,
) -> Column:
    """Cut text beyond `limit` at its last sentence end, if that lies past `share` of the limit."""

    def cut(text: Column) -> Column:
        return bind(F.substring(text, 1, limit), lambda head: bind(_sentences(head), lambda ended: joined(head, ended)))

    def joined(head: Column, ended: Column) -> Column:
        # The position of the last sentence end, counted from 0, must lie past the share.
        late = F.length(ended) - 1 > F.lit(limit * share)
        return F.concat(F.when(late, ended).otherwise(head), F.lit(suffix))

    text = _col(text)
    return F.when(F.length(text) > limit, cut(text)).otherwise(text)


def _sentences(text: Column) -> Column:
    """The text up to its last sentence end that is followed by a blank or a new line."""
    return F.regexp_extract(text, r"(?s)^(.*[.!?])[ \n]", 1)


def ensure_mention(
    text: Column | str,
    wanted: Column,
    addition: Column | str = fixed.MAP_SENTENCE,
    words: Sequence[str] = fixed.MAP_WORDS,
) -> Column:
    """Append `addition` where it is wanted and none of `words` occurs."""
    text = _col(text)
    addition = F.lit(addition) if isinstance(addition, str) else addition
    missing = wanted & bind(F.lower(text), lambda lowered: ~contains_any(lowered, words))
    return F.when(missing, F.concat(text, addition)).otherwise(text)


def spaced_number(number: Column | str) -> Column:
    """Whole number with thousands set apart by blanks."""
    return F.replace(F.format_number(_col(number), 0), F.lit(","), F.lit(" "))


def strip_code_fence(text: Column | str) -> Column:
    """Take a code fence off a response: the opening one, with or without `sql`, and the closing one."""
    text = strip(text)
    text = F.regexp_replace(text, r"^```sql", "")
    text = F.regexp_replace(text, r"^```", "")
    text = F.regexp_replace(text, r"```\z", "")
    return strip(text)


def drop_fence_lines(text: Column | str) -> Column:
    """For text that starts with a fence, drop every line that starts with one."""

    def clean(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: ~F.startswith(strip(line), F.lit(FENCE)))
        return F.when(F.startswith(text, F.lit(FENCE)), strip(F.array_join(lines, "\n"))).otherwise(text)

    return bind(strip(text), clean)


def is_yes(answer: Column | str, words: Sequence[str] = fixed.YES_WORDS, exact: bool = False) -> Column:
    """Verdict: the trimmed, upper-cased answer contains a yes word (or, if `exact`, is one)."""
    answer = F.upper(strip(answer))
    if exact:
        bare = F.regexp_replace(answer, r"[\p{Punct}]+\z", "")
        return F.coalesce(bare.isin(*words), F.lit(False))
    return F.coalesce(bind(answer, lambda a: contains_any(a, words)), F.lit(False))


def feature_name(
    text: Column | str,
    feature: Column | None = None,
    name: Column | None = None,
    strip_prefix: bool = False,
) -> Column:
    """Name of a catalog entry: its field, else the first short line among the first three."""
    lines = F.transform(F.slice(F.split(_col(text), "\n"), 1, fixed.NAME_LINES), strip)
    short = F.filter(lines, lambda line: (line != "") & (F.length(line) < fixed.NAME_LENGTH))
    given = [F.nullif(c, F.lit("")) for c in (feature, name) if c is not None]
    found = F.coalesce(*given, F.get(short, F.lit(0)))
    if strip_prefix:
        found = F.regexp_replace(found, f"^{fixed.NAME_PREFIX}", "")
    return found


def feature_description(text: Column | str, description: Column | None = None) -> Column:
    """Page text, else the description field, cut to its limit."""
    given = [F.nullif(_col(text), F.lit(""))]
    if description is not None:
        given.append(description)
    return F.substring(F.coalesce(*given, F.lit("")), 1, fixed.DESCRIPTION_LENGTH)


def catalog_text(name: Column | str, description: Column | str) -> Column:
    """Text of a catalog entry."""
    return F.concat(
        F.lit(fixed.NAME_PREFIX), _col(name), F.lit("\n" + fixed.DESCRIPTION_PREFIX), _col(description)
    )


def generation_failed(description: Column | str) -> Column:
    return F.startswith(_col(description), F.lit(fixed.FAILURE_MARKER))


def candidate_names(message: Column | str) -> Column:
    """Quoted names after `Candidate bindings:` on the same line of an error message."""
    line = F.regexp_extract(_col(message), r"Candidate bindings:\s*([^\n]+)", 1)
    return F.regexp_extract_all(line, F.lit(r'"([^"]+)"'), 1)


def percent_value(text: Column | str) -> Column:
    """`1.0%` is the number 1.0: the per cent sign is only a unit."""
    return F.regexp_replace(strip(text), r"\s*%\z", "").try_cast("double")
