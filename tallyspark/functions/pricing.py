"""Price tables and the cost of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (event column, price column), in the order in which costs are added.
PARTS = [("input_tokens", "input"), ("output_tokens", "output"), ("cache_creation_tokens", "cache_create"), ("cache_read_tokens", "cache_read")]
PRICE_COLUMNS = [p for _, p in PARTS]
MODES = ("auto", "calculate", "display")
#: Model families, sought in this order.
FAMILIES = ("fable", "opus", "sonnet", "haiku")
#: A price table up to this many rows is broadcast; models are few, so it always is in practice.
MANY_PRICES = 100_000


def family(model: Column) -> Column:
    out = F.lit("Unknown")
    for name in reversed(FAMILIES):
        out = F.when(F.lower(model).contains(name), name.capitalize()).otherwise(out)
    return out


def prices_from_json(text: DataFrame) -> DataFrame:
    """Text rows of one JSON object (model -> prices) to a price table: finite prices in [0, 1], rows without any dropped."""
    kind = "map<string, struct<input_cost_per_token:double, output_cost_per_token:double, cache_creation_input_token_cost:double, cache_read_input_token_cost:double>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("model_key", "p"))
    ok = lambda c: F.when((c >= 0) & (c <= 1) & ~F.isnan(c), c)
    names = ["input_cost_per_token", "output_cost_per_token", "cache_creation_input_token_cost", "cache_read_input_token_cost"]
    rows = rows.filter(F.lower("model_key").contains("claude")).select("model_key", *(ok(F.col(f"p.{n}")).alias(p) for n, p in zip(names, PRICE_COLUMNS, strict=True)))
    return rows.filter(F.coalesce(*PRICE_COLUMNS).isNotNull())


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, if it has at least half as many models as old; else old."""
    return new if 2 * new.count() >= old.count() and new.limit(1).count() else old


def gap_filled(prices: DataFrame, overrides: DataFrame) -> DataFrame:
    """prices, with the rows of overrides whose key it lacks."""
    return prices.unionByName(overrides.join(prices.select("model_key"), "model_key", "left_anti"))


def candidates(model: Column) -> list[Column]:
    """Price keys to try, in order: as it is, after the last '/', each without a date at its end."""
    tail = F.element_at(F.split(model, "/"), -1)
    undated = lambda c: F.regexp_replace(c, r"-\d{8}$", "")
    return [model, tail, undated(model), undated(tail)]


def with_price(events: DataFrame, prices: DataFrame) -> DataFrame:
    """events with price_key (null: none fits) and the price columns. The price table is joined by broadcast for each
    candidate key, so events are not shuffled."""
    if prices.limit(MANY_PRICES + 1).count() <= MANY_PRICES:
        prices = F.broadcast(prices)
    for i, key in enumerate(candidates(F.col("model"))):
        own = prices.select(F.col("model_key").alias(f"_k{i}"), F.struct(F.col("model_key").alias("price_key"), *PRICE_COLUMNS).alias(f"_p{i}"))
        events = events.join(own, key == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = F.coalesce(*(F.col(f"_p{i}") for i in range(4)))
    return events.withColumn("_p", found).drop(*(f"_p{i}" for i in range(4))).select("*", "_p.*").drop("_p")


def with_cost(events: DataFrame, prices: DataFrame, mode: str = "auto") -> DataFrame:
    """events with cost, computed (the cost by prices) and, scaled to cost, cost_input, cost_output, cost_cache."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    events = with_price(events, prices)
    part = [F.col(c) * F.coalesce(p, F.lit(0.0)) for c, p in PARTS]
    events = events.withColumns({f"_c{i}": p for i, p in enumerate(part)}).withColumn("computed", F.col("_c0") + F.col("_c1") + F.col("_c2") + F.col("_c3"))
    stored = F.col("cost_usd")
    cost = {"auto": F.coalesce(stored, "computed"), "calculate": F.col("computed"), "display": F.coalesce(stored, F.lit(0.0))}[mode]
    scale = F.when(F.col("computed") > 0, F.col("cost") / F.col("computed")).otherwise(0.0)
    events = events.withColumn("cost", cost).withColumn("_s", scale)
    return events.withColumns({"cost_input": F.col("_c0") * F.col("_s"), "cost_output": F.col("_c1") * F.col("_s"), "cost_cache": (F.col("_c2") + F.col("_c3")) * F.col("_s")}).drop("_c0", "_c1", "_c2", "_c3", "_s", *PRICE_COLUMNS)
