"""Mixing sources to target shares by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window, functions as F

from mostrador.llm.common import plain_text, stored

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, STORED_EVERY, SEED = 10, 5, "mix"
#: How much of a dimension's target is its own share of the tokens; the rest is spread evenly over its values.
NATURAL = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Tables without topics: the length of a text, in tokens, stands for it.
SHORT, LONG = 100, 1000
UNKNOWN = "unknown"
#: Part of all tokens that a sample drawn to a budget holds.
BUDGET = 0.25


def n_tokens(text: Column) -> Column:
    """Words between spaces, tabs and line ends; an empty text weighs one, so that every cell has some weight."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(1)).cast("long")


def length_topic(tokens: Column) -> Column:
    return F.when(tokens < SHORT, "short").when(tokens < LONG, "medium").otherwise("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns and _source, _lang, _topic, _tokens; a NULL source or language is one value."""
    named = docs.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("source", "lang")})
    return named.withColumn("_tokens", n_tokens(plain_text("text"))).withColumn("_topic", length_topic(F.col("_tokens")))


def blended_targets(cells: DataFrame, natural: dict[str, float] = NATURAL) -> dict[str, DataFrame]:
    """For each dimension the shares (value, share) that lie between those of the tokens and equal ones."""
    whole = cells.agg(F.sum("tokens").alias("tokens"), *[F.count_distinct(name).alias(name) for name in natural]).first()
    targets = {}
    for name, part in natural.items():
        even = (1 - part) / max(1, whole[name])
        targets[name] = cells.groupBy(F.col(name).alias("value")).agg(
            (part * F.sum("tokens") / F.lit(whole.tokens) + even).alias("share"))
    return targets


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions and tokens) with ``weight``, their share of the tokens after raking.

    A round scales the weights to each dimension's targets (value, share) in turn. A value without a target gets
    weight 0; targets without a cell are left out and the others scaled up. There is one row per cell, so a source
    with a third of all documents has a few rows here; the cells of one value are summed in a window.
    """
    whole = cells.agg(F.sum("tokens").alias("tokens")).first().tokens
    weighted = cells.withColumn("weight", F.col("tokens") / F.lit(whole))
    for name, target in targets.items():
        present = target.join(cells.select(F.col(name).alias("value")).distinct(), "value", "left_semi")
        total = present.agg(F.sum("share").alias("share")).first().share or 1.0
        shares = present.select(F.col("value").alias(name), (F.col("share") / F.lit(total)).alias(f"_share_{name}"))
        weighted = weighted.join(shares, name, "left")
    weighted = stored(weighted)
    for done in range(1, rounds + 1):
        for name in targets:
            reached = F.sum("weight").over(Window.partitionBy(name))
            scale = F.when(reached > 0, F.coalesce(f"_share_{name}", F.lit(0.0)) / reached).otherwise(0.0)
            weighted = weighted.withColumn("weight", F.col("weight") * scale)
        if done % STORED_EVERY == 0:
            weighted = stored(weighted)
    return weighted.select(*cells.columns, "weight")


def chances(cells: DataFrame, weighted: DataFrame) -> DataFrame:
    """Cells with ``weight`` and ``probability``: weight over own share, scaled so that the largest is 1.

    So no probability is cut off, and the expected tokens of a sample keep the raked shares.
    """
    whole = cells.agg(F.sum("tokens").alias("tokens")).first().tokens
    ratio = stored(weighted.withColumn("weight", F.col("weight") * F.lit(whole) / F.col("tokens")))
    most = ratio.agg(F.max("weight").alias("weight")).first().weight
    return ratio.withColumn("probability", F.col("weight") / F.lit(most))


def level(rows: DataFrame, budget: float) -> float:
    """The factor at which the sum of least(tokens, factor * rate) is ``budget``, or all rows with a rate are whole.

    Each step takes the rows that the last factor fills as whole and solves for the others; the factor only grows.
    """
    factor = 0.0
    while True:
        full = F.col("tokens") <= F.lit(factor) * F.col("rate")
        got = rows.where("rate > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("rate"))).alias("rate"),
                                         F.max(F.col("tokens") / F.col("rate")).alias("most")).first()
        if not got.rate:
            return got.most or 0.0
        before, factor = factor, max(factor, (budget - (got.full or 0)) / got.rate)
        if factor <= before * (1 + 1e-12):
            return factor


def goals(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> dict[str, DataFrame]:
    """For each dimension the tokens that a sample of ``budget`` tokens takes of each value: rows (value, wanted, goal, whole).

    ``wanted`` is the target's part of the budget. No value can give more tokens than it has: one that is wanted beyond
    that is taken whole, and what is missing goes to the others in the proportion of their targets.
    """
    out = {}
    for name, target in targets.items():
        held = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"))
        held = stored(held.join(target, "value", "left").select("value", "tokens", F.coalesce("share", F.lit(0.0)).alias("rate")))
        factor, shares = level(held, budget), held.agg(F.sum("rate").alias("rate")).first().rate or 1.0
        goal = F.lit(factor) * F.col("rate")
        out[name] = held.select("value", (F.col("rate") * F.lit(budget / shares)).alias("wanted"),
                                F.least(F.col("tokens").cast("double"), goal).alias("goal"), (goal >= F.col("tokens")).alias("whole"))
    return out


def filled(weighted: DataFrame, name: str) -> DataFrame:
    """``weighted`` with the ratios of each value of ``name`` scaled so that least(1, ratio) of its tokens is its goal.

    A cell is full where the goal suffices with the factor that just fills it; the factor is solved for the others.
    """
    value = Window.partitionBy(name)
    smaller = value.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    tokens, ratio, goal = F.col("tokens"), F.col("ratio"), F.col(f"_goal_{name}")
    rest = F.coalesce(F.sum(ratio * tokens).over(smaller), F.lit(0.0))
    above = F.sum(tokens).over(value) - F.coalesce(F.sum(tokens).over(smaller), F.lit(0))
    marked = weighted.withColumn("_full", F.when(ratio > 0, above + rest / ratio <= goal).otherwise(False))
    open_ = F.sum(F.when(~F.col("_full"), ratio * tokens)).over(value)
    full = F.coalesce(F.sum(F.when(F.col("_full"), tokens)).over(value), F.lit(0))
    factor = F.when(open_ > 0, F.greatest(goal - full, F.lit(0.0)) / open_).otherwise(F.max(F.when(F.col("_full"), 1 / ratio)).over(value))
    return marked.withColumn("_factor", F.coalesce(factor, F.lit(0.0))).withColumn("ratio", ratio * F.col("_factor")).drop("_full", "_factor")


def budget_chances(cells: DataFrame, wanted: dict[str, DataFrame], part: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight`` and ``probability`` of a sample that holds ``part`` of all tokens, however rare a value is.

    The ``wanted`` :func:`goals` are raked with cells that are full held at 1. Cells of a value that is to be taken whole
    have probability 1; the others least(1, c * ratio), with the c that meets the budget. ``weight`` is the share in the
    sample over the own share. Goals that contradict each other leave a shortfall, see :func:`shortfalls`.
    """
    budget = part * (cells.agg(F.sum("tokens").alias("tokens")).first().tokens or 0)
    weighted, whole, given = cells.withColumn("ratio", F.lit(1.0)), F.lit(False), F.lit(True)
    for name, goal in wanted.items():
        weighted = weighted.join(goal.select(F.col("value").alias(name), F.col("goal").alias(f"_goal_{name}"), F.col("whole").alias(f"_whole_{name}")), name)
        whole, given = whole | F.col(f"_whole_{name}"), given & (F.col(f"_goal_{name}") > 0)
    weighted = stored(weighted.withColumn("_whole", whole & given))
    for _ in range(rounds):
        for name in wanted:
            weighted = filled(weighted, name)
        weighted = stored(weighted)
    rest = weighted.where("not _whole").select("tokens", (F.col("ratio") * F.col("tokens")).alias("rate"))
    kept = weighted.where("_whole").agg(F.sum("tokens").alias("tokens")).first().tokens or 0
    chance = F.when(F.col("_whole"), 1.0).otherwise(F.least(F.lit(1.0), F.lit(level(rest, max(0.0, budget - kept))) * F.col("ratio")))
    return weighted.withColumn("probability", chance).select(*cells.columns, (F.col("probability") / F.lit(part)).alias("weight"), "probability")


def shortfalls(chance: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """Rows (dimension, value, wanted, drawn, missing) in tokens: what each target asks of the budget, and the expected draw."""
    out = None
    for name, goal in wanted.items():
        drawn = chance.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("drawn"))
        rows = goal.join(drawn, "value").select(F.lit(name).alias("dimension"), "value", "wanted", "drawn",
                                                F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0.0)).alias("missing"))
        out = rows if out is None else out.union(rows)
    return out


def draw(key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** 13))


def cell_chances(rows: DataFrame, targets: dict[str, DataFrame] | None = None, part: float | None = None) -> DataFrame:
    """Cells of measured rows with their probability; without given targets the blended ones hold.

    With ``part`` the sample holds that part of the tokens, and what targets miss is logged; without it the cell with
    the largest weight sets its size, and one rare value can make it small.
    """
    cells = stored(rows.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens")))
    targets = targets or blended_targets(cells)
    if part is None:
        return chances(cells, rake(cells, targets))
    wanted = goals(cells, targets, part * (cells.agg(F.sum("tokens").alias("tokens")).first().tokens or 0))
    chance = stored(budget_chances(cells, wanted, part))
    for row in shortfalls(chance, wanted).groupBy("dimension").agg(
            F.sum("missing").alias("missing"), F.sum("wanted").alias("wanted"), F.sum((F.col("missing") >= 1).cast("int")).alias("values")).collect():
        if row["values"]:
            logging.getLogger(__name__).warning("%s: %d values miss %.0f of %.0f tokens", row.dimension, row["values"], row.missing, row.wanted)
    return chance


def sampling(docs: DataFrame, targets: dict[str, DataFrame] | None = None, part: float | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, lang, topic, tokens, weight, probability, sampled.

    The choice depends on doc_id and the probability alone, so it is the same in every run, and rows that share a
    doc_id and a cell go together. NULL sources and languages are the value "unknown", NULL texts are empty and weigh
    one token. No rows give no rows; other columns are not looked at. ``part`` is that of :func:`cell_chances`.
    """
    rows = stored(measured(docs).select("doc_id", *[f"_{d}" for d in DIMENSIONS], "_tokens"))
    chance = cell_chances(rows, targets, part)
    out = rows.withColumnsRenamed({f"_{d}": d for d in DIMENSIONS}).join(chance.drop("tokens"), list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, F.col("_tokens").alias("tokens"), "weight", "probability",
                      (draw(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sampled_rows(docs: DataFrame, targets: dict[str, DataFrame] | None = None, part: float | None = BUDGET) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns: ``part`` of their tokens, as in :func:`cell_chances`."""
    rows = measured(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang"))
    small = stored(rows.select(*[f"_{d}" for d in DIMENSIONS], "_tokens"))
    chance = cell_chances(small, targets, part).select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "probability")
    drawn = rows.join(chance, [f"_{d}" for d in DIMENSIONS]).where(draw(F.col("doc_id")) < F.col("probability"))
    return drawn.select("row.*")


def level_sql(rows: str, budget: str) -> str:
    """:func:`level` of the relation ``rows`` in closed form: in the order in which rows become whole, those are whole at
    whose factor the budget is not passed."""
    return f"""(SELECT CASE WHEN bool_and(full_) THEN max(tokens / rate) ELSE ({budget} - coalesce(sum(tokens) FILTER (full_), 0))
        / sum(rate) FILTER (NOT full_) END FROM (SELECT tokens, rate, sum(tokens) OVER (ORDER BY tokens / rate ROWS UNBOUNDED PRECEDING)
        + tokens / rate * coalesce(sum(rate) OVER (ORDER BY tokens / rate ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
        <= {budget} AS full_ FROM {rows} WHERE rate > 0))"""


def sql(part: float = BUDGET) -> str:
    """:func:`sampling` with ``part`` and the blended targets in SQL, the rounds written out."""
    budget = "(SELECT budget FROM whole)"
    targets, goal = [], []
    for d, natural in NATURAL.items():
        targets.append(f"""t_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS tokens, {natural} * sum(tokens) / (SELECT tokens FROM whole)
            + {1 - natural} / (SELECT count(DISTINCT {d}) FROM cells) AS rate FROM cells GROUP BY {d})""")
        goal.append(f"""g_{d} AS MATERIALIZED (SELECT {d}, least(tokens::DOUBLE, factor * rate) AS goal_{d}, factor * rate >= tokens AS whole_{d}
            FROM t_{d}, (SELECT {level_sql(f't_{d}', budget)} AS factor))""")
    steps, last = [], "r0"
    for i, d in enumerate(DIMENSIONS * ROUNDS, 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT * EXCLUDE (full_, open_, full_tokens, longest) REPLACE (ratio * coalesce(CASE WHEN open_ > 0 THEN greatest(goal_{d} - full_tokens, 0) / open_
            ELSE longest END, 0) AS ratio) FROM (
            SELECT *, coalesce(sum(ratio * tokens) FILTER (NOT full_) OVER (PARTITION BY {d}), 0) AS open_,
                   coalesce(sum(tokens) FILTER (full_) OVER (PARTITION BY {d}), 0) AS full_tokens, max(1 / ratio) FILTER (full_) OVER (PARTITION BY {d}) AS longest
            FROM (SELECT *, CASE WHEN ratio > 0 THEN sum(tokens) OVER (PARTITION BY {d}) - coalesce(sum(tokens) OVER smaller, 0)
                  + coalesce(sum(ratio * tokens) OVER smaller, 0) / ratio <= goal_{d} ELSE false END AS full_ FROM {last}
                  WINDOW smaller AS (PARTITION BY {d} ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))""")
        last = f"r{i}"
    digits = " + ".join(f"(strpos('0123456789abcdef', h[{i + 1}]) - 1) * {16 ** (12 - i)}::BIGINT" for i in range(13))
    return f"""WITH rows AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
        greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')), 1) AS tokens,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    placed AS MATERIALIZED (SELECT *, CASE WHEN tokens < {SHORT} THEN 'short' WHEN tokens < {LONG} THEN 'medium'
        ELSE 'long' END AS topic, ({digits})::DOUBLE / {16 ** 13} AS u FROM rows),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM placed GROUP BY ALL),
    whole AS MATERIALIZED (SELECT sum(tokens) AS tokens, {part}::DOUBLE * sum(tokens) AS budget FROM cells),
    {", ".join(targets)}, {", ".join(goal)},
    r0 AS MATERIALIZED (SELECT *, 1::DOUBLE AS ratio, whole_source OR whole_lang OR whole_topic AS taken
        FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
    {", ".join(steps)},
    rest AS MATERIALIZED (SELECT tokens, ratio * tokens AS rate FROM {last} WHERE NOT taken),
    left_ AS MATERIALIZED (SELECT greatest(0, budget - (SELECT coalesce(sum(tokens), 0) FROM {last} WHERE taken)) AS budget FROM whole),
    chance AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN taken THEN 1 ELSE least(1, factor * ratio) END AS probability
        FROM {last}, (SELECT coalesce({level_sql('rest', '(SELECT budget FROM left_)')}, 0) AS factor))
    SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(probability / {part}, 6) AS weight,
           round(probability, 6) AS probability, u < probability AS sampled
    FROM placed JOIN chance USING (source, lang, topic)"""
