"""Mixing sources to target weights: temperature over token shares, then block permutations cut at a budget.

A source's weight is its share of all words raised to an exponent, and normalised. The exponent is bisected on a grid of 2^20
steps: the largest at which the weights' entropy reaches `entropy` of the greatest possible, but no less than the smallest at which
no source is repeated more than `repeats` times; so the limit wins over the entropy. Each pass over the table of sources makes five
halvings.

A source's budget is its weight of the total budget, in words. It is realised in epochs. An epoch is a permutation of the source's
blocks (documents by a hash of the id); whole epochs are taken as often as they fit, and the last one as far as the budget goes:
whole blocks, then of the block that crosses it whole parts, then of the part that crosses it documents. There are `BLOCKS` blocks a
source and `BLOCKS` parts a block, so no window holds more rows of a source than that, but for the documents of one part.

Only built-in functions run here. A null source is a source of its own, the empty name; null and empty texts have no words and come
along with their block at no cost, and all documents of a source without any words are taken once. Rows of equal id share a block and
follow a hash of the text; equal rows come along together or not at all. A very long text may be the one that a budget does not reach. An
empty table gives no rows. Columns of the documents stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import NO_ID, Stored, public_id

ENTROPY = 0.95
REPEATS = 4.0
BLOCKS = 4096
STEPS = 1 << 20
#: Added to a budget before its fraction is cut off, so that what is whole but for the order of a sum stays whole.
WHOLE = 1e-6
_WAYS = 32
WORD = r"[^\x20\x09-\x0D]+"


def _number(text: Column) -> Column:
    """60 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    place = _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_did"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_rk"),
        source.alias("_source"), place.alias("_place"),
        (place % BLOCKS).cast("int").alias("_block"), (F.call_function("div", place, F.lit(BLOCKS)) % BLOCKS).cast("int").alias("_part"),
    ]


def _turn(epoch: Column, seed: int) -> Column:
    """The place of a block in an epoch's permutation."""
    return _number(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("_source"), F.col("_block").cast("string")))


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, per_word: float = 1.0) -> float:
    """The exponent for `sources(share)`; `per_word` is the budget over the number of words. The driver gets a few sums a pass."""
    n = sources.count()
    if n < 2:
        return 1.0

    def measures(steps: list[int]) -> dict[int, tuple[float, float]]:
        a = F.col("step") / STEPS
        rows = (
            sources.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).groupBy("step")
            .agg(F.sum(F.pow("share", a)).alias("z"), F.sum(F.pow("share", a) * F.log("share")).alias("s"), F.max(F.pow("share", a - 1)).alias("m"))
            .select("step", (F.log("z") - a * F.col("s") / F.col("z")).alias("h"), (F.col("m") / F.col("z") * per_word).alias("r"))
        )
        return {r.step: (r.h, r.r) for r in rows.collect()}

    def last(holds) -> int:
        """The last step of which `holds`, which it does up to a point; -1 if of none."""
        low, high = -1, STEPS + 1
        while high - low > 1:
            gap = max(1, (high - low) // _WAYS)
            steps = sorted({min(high - 1, low + gap * i) for i in range(1, _WAYS + 1)})
            found = measures(steps)
            good = [s for s in steps if holds(*found[s])]
            low = max([low, *good])
            high = min([high, *(s for s in steps if s > low)])
        return low

    target = entropy * math.log(n)
    step = max(0, last(lambda h, r: h >= target), min(STEPS, last(lambda h, r: r > repeats) + 1))
    return step / STEPS


def mixing_plan(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The documents' keys with `n_tokens`, and one row per source: its words, weight, budget, epochs, and where the last one ends."""
    meta = Stored(docs.select(*_keys(docs, seed), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")), "mixing-keys").df
    sources = Stored(meta.groupBy("_source").agg(F.sum("n_tokens").alias("words")).where("words > 0"), "mixing-sources").df
    total = sources.agg(F.sum("words")).first()[0] or 0
    budget = total if budget is None else budget
    shares = sources.withColumn("share", F.col("words") / F.lit(float(total or 1)))
    power = exponent(shares, entropy, repeats, budget / (total or 1))
    z = shares.agg(F.sum(F.pow("share", F.lit(power)))).first()[0] or 1.0
    plan = (
        shares.withColumn("weight", F.pow("share", F.lit(power)) / z)
        .withColumn("budget", F.floor(F.col("weight") * budget + WHOLE).cast("long"))
        .withColumn("epochs", F.floor(F.col("budget") / F.col("words")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("words"))
    )
    plan = Stored(plan, "mixing-plan").df

    def crossing(rows: DataFrame, by: list, left: str, keep: list) -> DataFrame:
        """Of each source the first row whose running sum of `size` exceeds `left`, and what was left before it."""
        run = F.sum("size").over(Window.partitionBy("_source").orderBy(*by))
        return (
            rows.withColumn("run", run).where((F.col("run") > F.col(left)) & (F.col("run") - F.col("size") <= F.col(left)))
            .select("_source", *keep, (F.col(left) - F.col("run") + F.col("size")).alias("left"))
        )

    blocks = meta.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("size")).join(plan.select("_source", "epochs", "rest"), "_source")
    block = crossing(blocks.withColumn("turn", _turn(F.col("epochs"), seed)), ["turn", "_block"], "rest", ["turn", "_block"])
    block = Stored(block, "mixing-blocks").df
    parts = meta.join(block, ["_source", "_block"]).groupBy("_source", "_part", "left").agg(F.sum("n_tokens").alias("size"))
    part = Stored(crossing(parts, ["_part"], "left", ["_part"]).withColumnRenamed("left", "over"), "mixing-parts").df
    inside = meta.join(block, ["_source", "_block"]).join(part, ["_source", "_part"])
    run = F.sum("n_tokens").over(Window.partitionBy("_source").orderBy("_place", "_did", "_rk"))
    end = (
        inside.withColumn("run", run).where(F.col("run") <= F.col("over"))
        .groupBy("_source").agg(F.max(F.struct("_place", "_did", "_rk")).alias("end"))
    )
    ends = (
        plan.join(block.select("_source", F.col("turn").alias("end_turn"), F.col("_block").alias("end_block")), "_source", "left")
        .join(part.select("_source", F.col("_part").alias("end_part")), "_source", "left").join(end, "_source", "left")
    )
    return meta, Stored(ends, "mixing-ends").df


def _copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`rows` (with the keys) with `copies`; sources without words are not in the plan, and their rows are taken once."""
    turn = F.struct(_turn(F.col("epochs"), seed).alias("t"), F.col("_block").alias("b"))
    limit = F.struct(F.col("end_turn").alias("t"), F.col("end_block").alias("b"))
    inside = (F.col("_part") < F.col("end_part")) | (
        (F.col("_part") == F.col("end_part")) & F.coalesce(F.struct("_place", "_did", "_rk") <= F.col("end"), F.lit(False))
    )
    more = (turn < limit) | ((turn == limit) & inside)
    copies = F.when(F.col("epochs").isNull(), 1).otherwise(F.col("epochs") + F.coalesce(more, F.lit(False)).cast("int"))
    return rows.join(plan, "_source", "left").withColumn("copies", copies)


def mixing_counts(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 1) -> DataFrame:
    """`doc_id`, `source`, `n_tokens`, `copies` (how often the document is in the mixture), one row per document."""
    meta, plan = mixing_plan(docs, entropy, repeats, budget, seed)
    return _copies(meta, plan, seed).select(public_id("_did"), F.col("_source").alias("source"), "n_tokens", "copies")


def mixture(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 1, order: bool = True
) -> DataFrame:
    """The documents, each as often as the mixture has it; with `order` also `mix_epoch`, `mix_turn`, `mix_place`, by which to sort."""
    _, plan = mixing_plan(docs, entropy, repeats, budget, seed)
    own = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    # Only the keys and the row go on, so that columns of the documents cannot clash with the plan's.
    rows = _copies(docs.select(own, *_keys(docs, seed)), plan, seed).where("copies > 0")
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    extra = [F.col("mix_epoch"), _turn(F.col("mix_epoch"), seed).alias("mix_turn"), F.col("_place").alias("mix_place")] if order else []
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns), *extra)


def mixing_sql(entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 1) -> str:
    """`mixing_counts` in SQL; ids must be unique, and the budget is the number of words."""
    entropy_of = f"(SELECT ln(sum(pow(share, a))) - a * sum(pow(share, a) * ln(share)) / sum(pow(share, a)) FROM (SELECT share, %s / {STEPS}.0::DOUBLE AS a FROM p) GROUP BY a)"
    repeats_of = f"(SELECT max(pow(share, a - 1)) / sum(pow(share, a)) FROM (SELECT share, %s / {STEPS}.0::DOUBLE AS a FROM p) GROUP BY a)"
    rounds = STEPS.bit_length() + 1
    number = "('0x' || substr(md5(%s), 1, 15))::BIGINT"
    turn = number % f"'{seed}:' || epochs || ':' || source || ':' || block"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
    {number % f"'{seed}:' || doc_id"} AS place FROM documents),
m AS (SELECT *, place % {BLOCKS} AS block, place // {BLOCKS} % {BLOCKS} AS part FROM d),
s AS (SELECT source, sum(n)::BIGINT AS words FROM m GROUP BY source HAVING sum(n) > 0),
p AS (SELECT source, words, words / (SELECT sum(words) FROM s)::DOUBLE AS share FROM s),
h(round, low, high) AS (
  SELECT 0, -1, {STEPS + 1} UNION ALL
  SELECT round + 1, CASE WHEN ok THEN middle ELSE low END, CASE WHEN ok THEN high ELSE middle END
  FROM (SELECT *, {entropy_of % 'middle'} >= {entropy} * ln((SELECT count(*) FROM p)) AS ok
        FROM (SELECT *, (low + high) // 2 AS middle FROM h WHERE round < {rounds} AND high - low > 1))),
r(round, low, high) AS (
  SELECT 0, -1, {STEPS + 1} UNION ALL
  SELECT round + 1, CASE WHEN ok THEN middle ELSE low END, CASE WHEN ok THEN high ELSE middle END
  FROM (SELECT *, {repeats_of % 'middle'} > {repeats} AS ok
        FROM (SELECT *, (low + high) // 2 AS middle FROM r WHERE round < {rounds} AND high - low > 1))),
a AS (
  SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1.0::DOUBLE
    ELSE greatest(0, (SELECT max(low) FROM h), least({STEPS}, (SELECT max(low) FROM r) + 1)) / {STEPS}.0::DOUBLE END AS power),
w AS (SELECT source, words, pow(share, power) / (SELECT sum(pow(share, power)) FROM p, a) AS weight FROM p, a),
b AS (SELECT *, floor(weight * (SELECT sum(words) FROM s)::BIGINT + {WHOLE}::DOUBLE)::BIGINT AS budget FROM w),
e AS (SELECT *, (budget // words)::INTEGER AS epochs, budget % words AS rest FROM b),
k AS (SELECT source, block, epochs, rest, sum(n)::BIGINT AS size FROM m JOIN e USING (source) GROUP BY ALL),
kr AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, block) AS run FROM (SELECT *, {turn} AS turn FROM k)),
kc AS (SELECT source, turn AS end_turn, block AS end_block, rest - run + size AS over FROM kr WHERE run > rest AND run - size <= rest),
q AS (
  SELECT doc_id, source, n, epochs, ({turn}, block) AS turn, (end_turn, end_block) AS limit_,
    sum(n) OVER (PARTITION BY source, block ORDER BY part, place, doc_id) AS run, over
  FROM m LEFT JOIN e USING (source) LEFT JOIN kc USING (source))
SELECT doc_id, source, n AS n_tokens, CASE WHEN epochs IS NULL THEN 1 ELSE epochs END + CASE WHEN turn < limit_ OR (turn = limit_ AND run <= over) THEN 1 ELSE 0 END AS copies FROM q"""
