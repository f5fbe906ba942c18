"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Every text is read once: a row a document with its cell (source, language, topic) and its number of tokens is stored, and
token mass is summed to cells. Each sweep rakes the cells to the three target marginals in turn, until every marginal is
met to `tolerance`. Targets are weights of the values of a marginal (`targets`); a marginal without any is tempered: its
observed shares to the power TEMPER. Stated targets that no factors can meet raise, with the distance left; tempered ones
(a tiny table, whose empty cells tie one marginal to another) are met as far as sweeps get, with a warning. A document's inclusion probability is its cell's factor over the largest one, so that the expected token shares of the sample are the
targets. It is taken when a hash of its id, as a number in [0, 1), is below its probability: the choice is reproducible
on any cluster.

Defined cases: null source or language count as '(none)'; a null text is empty; an empty text has no tokens and
the topic 'empty', and documents of cells without tokens stay (probability 1); equal or null ids share one
hash and, within a cell, one fate. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, sorted_in, stored

#: Target of a marginal without stated weights: its observed shares to this power, normalised. Below 1 this lifts small groups.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Marginals are met to this part of all tokens, in so many sweeps at most.
TOLERANCE, MOST_SWEEPS = 1e-10, 200
#: Cells up to this many are fitted in one partition and broadcast; more are fitted by shuffles and joined with salt.
FEW_CELLS = 100_000
SALTS = 16
DIMS = ("source", "lang", "topic")
SYMBOLS = "#$%&*@=<>{}[]|^~_+/"
DIGITS = "0123456789"
#: What topics and token counts look at, as Java patterns.
PLAIN = r"[^0-9#$%&*@=<>{}\[\]|\^~_+/\n]++"
TOKEN = r"[ \t\n\x0B\f\r]*+[^ \t\n\x0B\f\r]++[ \t\n\x0B\f\r]*+"


def token_count(text: Column) -> Column:
    """Runs of what is not white space: each becomes one sign, with the space around it."""
    return F.when(F.btrim(text, F.lit(SPACE)) == "", 0).otherwise(F.length(F.regexp_replace(text, TOKEN, "x")))


def topic_of(n: Column, signs: Column) -> Column:
    """A coarse topic from the length of the whole text and its digits, symbols and line ends: empty, numeric, symbols,
    lines (short ones) or prose."""
    count = lambda chars: F.length(signs) - F.length(F.translate(signs, chars, ""))
    return (
        F.when(n == 0, "empty").when(count(DIGITS) / n >= 0.01, "numeric").when(count(SYMBOLS) / n >= 0.02, "symbols")
        .when(n / (count("\n") + 1) < 200, "lines").otherwise("prose")
    )


def described(docs: DataFrame, *more: Column) -> DataFrame:
    """What else is asked for, then source, lang, topic and n_tokens of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    rows = docs.select(*more, *kind, F.length(text).alias("_n"), F.regexp_replace(text, PLAIN, "").alias("_signs"), token_count(text).cast("long").alias("n_tokens"))
    return rows.select(*rows.columns[: len(more) + 2], topic_of(F.col("_n"), F.col("_signs")).alias("topic"), "n_tokens")


def wanted(cells: DataFrame, d: str, total: float, temper: dict[str, float], targets: dict[str, dict[str, float]]) -> Column:
    """The token mass that cells of one value of d shall have together."""
    masses = cells.groupBy(d).agg(F.sum("mass").alias("mass"))
    if d not in targets:
        sums = masses.agg(F.sum(F.pow("mass", F.lit(temper[d])))).first()[0]
        return F.pow(F.sum("mass").over(Window.partitionBy(d)), F.lit(temper[d])) * F.lit(total / float(sums))
    weights = {str(v): float(w) for v, w in targets[d].items() if w}
    if not weights or min(weights.values()) < 0:
        raise ValueError(f"{d}: targets must be weights of 0 or more, and one over 0")
    lacking = weights.keys() - {r[0] for r in masses.filter(F.col(d).isin(*weights)).select(d).collect()}
    if lacking:
        raise ValueError(f"{d}: no tokens for the targets of {sorted(lacking)}")
    shares = F.create_map(*(F.lit(x) for v, w in weights.items() for x in (v, w / sum(weights.values()))))
    return F.coalesce(F.try_element_at(shares, F.col(d)), F.lit(0.0)) * F.lit(total)


def raked(
    cells: DataFrame, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS
) -> DataFrame:
    """cells: DIMS and mass, over 0. Adds factor, by which all marginals meet their targets to tolerance. A value without a
    weight in its marginal's targets gets none. If stated targets cannot be met it raises, with the distance left."""
    few = cells.count() <= FEW_CELLS
    # one partition satisfies every window below, so no sweep of a few cells shuffles
    near = lambda df: df.coalesce(1) if few else df
    cells = near(cells)
    total = cells.agg(F.sum("mass")).first()[0]
    if not total:
        return cells.withColumn("factor", F.lit(1.0))
    cells = cells.withColumns({f"t_{d}": wanted(cells, d, float(total), temper, targets or {}) for d in DIMS}).withColumn("factor", F.lit(1.0))
    now = lambda d: F.sum(F.col("mass") * F.col("factor")).over(Window.partitionBy(d))
    left, before = {}, float("inf")
    for _ in range(0, most, 2):
        for d in DIMS * 2:
            cells = cells.withColumn("now", now(d)).withColumn("factor", F.when(F.col("now") > 0, F.col("factor") * F.col(f"t_{d}") / F.col("now")).otherwise(F.col("factor"))).drop("now")
        cells = near(stored(cells, "raked"))  # a plan of all sweeps at once takes longer to optimise than to run
        gaps = cells.select(*(F.abs(now(d) - F.col(f"t_{d}")).alias(d) for d in DIMS)).agg(*(F.max(d).alias(d) for d in DIMS)).first()
        left = {d: gaps[d] / total for d in DIMS}
        if max(left.values()) <= tolerance:
            return cells.select(*DIMS, "mass", "factor")
        if max(left.values()) > 0.999 * before:
            break  # it goes round: no factors meet all targets
        before = max(left.values())
    said = f"targets not met; largest distance as a part of all tokens: {left}"
    if targets:
        raise ValueError(said)
    warnings.warn(said, stacklevel=2)
    return cells.select(*DIMS, "mass", "factor")


def with_probability(rows: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]] | None, tolerance: float) -> DataFrame:
    """rows as described() gives them, stored, with prob beside them."""
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("mass")), "cells")
    fitted = raked(cells.filter("mass > 0"), temper, targets, tolerance)
    highest = fitted.agg(F.max("factor")).first()[0] or 1.0
    # a cell without mass holds no tokens, so its documents stay
    prob = fitted.select(*DIMS, (F.col("factor") / F.lit(highest)).alias("prob")).unionByName(cells.filter("mass = 0").select(*DIMS, F.lit(1.0).alias("prob")))
    prob = stored(prob, "fitted")
    if prob.count() <= FEW_CELLS:
        return rows.join(F.broadcast(prob), list(DIMS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)))
    return rows.join(sorted_in(prob.withColumn("_salt", salts)), [*DIMS, "_salt"]).drop("_salt")


def mixed(docs: DataFrame, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs: doc_id, text, source, lang. Returns doc_id, source, lang, topic, n_tokens, prob and kept for every row."""
    rows = stored(described(docs, F.col("doc_id")), "described")
    found = with_probability(rows, temper, targets, tolerance)
    return found.select("doc_id", *DIMS, "n_tokens", "prob", (chance(F.col("doc_id")) < F.col("prob")).alias("kept"))


def mixed_documents(docs: DataFrame, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The sampled rows of docs, with the columns that docs has."""
    rows = described(docs, F.col("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    found = with_probability(stored(rows, "described"), temper, targets, tolerance)
    return found.filter(chance(F.col("doc_id")) < F.col("prob")).select("doc.*")


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sql(documents: str = "documents", temper: dict[str, float] = TEMPER, sweeps: int = 60) -> str:
    """The same in DuckDB SQL: a recursion of 3 x sweeps steps, far beyond the tolerance; prob rounded to 6 digits."""
    chars = lambda s: s.replace("'", "''")
    share = lambda s: f"(length(body) - length(translate(body, '{chars(s)}', ''))) / length(body)"
    target = lambda d: f"pow(sum(mass) OVER (PARTITION BY {d}), {temper[d]}) * (SELECT sum(mass) FROM cells) / (SELECT sum(t) FROM (SELECT pow(sum(mass), {temper[d]}) AS t FROM cells GROUP BY {d}))"
    step = " ".join(f"WHEN {i} THEN factor * t_{d} / sum(mass * factor) OVER (PARTITION BY {d})" for i, d in enumerate(DIMS))
    return f"""WITH RECURSIVE src AS (SELECT *, coalesce(text, '') AS body FROM {documents}),
described AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '(none)') AS source, coalesce(CAST(lang AS VARCHAR), '(none)') AS lang,
  CASE WHEN length(body) = 0 THEN 'empty' WHEN {share(DIGITS)} >= 0.01 THEN 'numeric' WHEN {share(SYMBOLS)} >= 0.02 THEN 'symbols'
    WHEN length(body) / (length(body) - length(replace(body, chr(10), '')) + 1) < 200 THEN 'lines' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(body, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM src),
every AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM described GROUP BY ALL),
cells AS (SELECT * FROM every WHERE mass > 0),
raked AS (SELECT source, lang, topic, mass, {", ".join(f"{target(d)} AS t_{d}" for d in DIMS)}, CAST(1 AS DOUBLE) AS factor, 0 AS k FROM cells
  UNION ALL SELECT source, lang, topic, mass, {", ".join(f"t_{d}" for d in DIMS)}, CASE k % 3 {step} END, k + 1 FROM raked WHERE k < {3 * sweeps}),
fitted AS (SELECT source, lang, topic, factor / max(factor) OVER () AS prob FROM raked WHERE k = {3 * sweeps} UNION ALL SELECT source, lang, topic, 1.0 FROM every WHERE mass = 0)
SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < prob AS kept
FROM described JOIN fitted USING (source, lang, topic)"""
