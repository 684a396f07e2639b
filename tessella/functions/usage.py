"""Token usage and cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# CNY for a million tokens, model names that are priced as another.
PRICES = [
    ("deepseek-v4-flash", 0.02, 1.0, 2.0),
    ("deepseek-v4-pro", 0.025, 3.0, 6.0),
]
ALIASES = [
    ("deepseek-chat", "deepseek-v4-flash"),
    ("deepseek-reasoner", "deepseek-v4-flash"),
    ("sensenova-6.7-flash-lite", "deepseek-v4-flash"),
]
TOKENS = ["prompt_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens", "completion_tokens", "reasoning_tokens", "total_tokens"]


def extracted(response: Column) -> Column:
    """Token counts of a raw JSON answer as a struct; what an answer leaves out is worked out from the rest."""

    def number(path: str) -> Column:
        return F.coalesce(F.get_json_object(response, f"$.usage.{path}").try_cast("double").try_cast("long"), F.lit(0))

    prompt, completion = number("prompt_tokens"), number("completion_tokens")
    hit = F.coalesce(F.nullif(number("prompt_cache_hit_tokens"), F.lit(0)), number("prompt_tokens_details.cached_tokens"))
    miss = F.coalesce(F.nullif(number("prompt_cache_miss_tokens"), F.lit(0)), F.when(prompt != 0, F.greatest(F.lit(0), prompt - hit)).otherwise(0))
    total = F.coalesce(F.nullif(number("total_tokens"), F.lit(0)), prompt + completion)
    values = [prompt, hit, miss, completion, number("completion_tokens_details.reasoning_tokens"), total]
    return F.struct(*(v.cast("long").alias(k) for k, v in zip(TOKENS, values)))


def hit_rate(hit: Column, prompt: Column) -> Column:
    return F.when(F.coalesce(prompt, F.lit(0)) <= 0, 0.0).otherwise(F.round(hit / prompt * 100, 2))


def price_table(spark: SparkSession) -> DataFrame:
    """``model``, ``hit_price``, ``miss_price``, ``out_price``: a handful of rows, aliases included."""
    prices = {m: p for m, *p in PRICES}
    rows = [(m, *p) for m, p in prices.items()] + [(a, *prices[m]) for a, m in ALIASES]
    return spark.createDataFrame(rows, "priced_model string, hit_price double, miss_price double, out_price double")


def priced(calls: DataFrame, model: str = "model") -> DataFrame:
    """The calls with ``cache_hit_rate_percent`` and ``price_cny``; unknown models cost nothing."""
    key = F.regexp_replace(F.lower(F.trim(model)), r"\[1m\]$", "")
    joined = calls.join(F.broadcast(price_table(calls.sparkSession)), key == F.col("priced_model"), "left")
    price = (
        F.col("prompt_cache_hit_tokens") / 1_000_000 * F.col("hit_price")
        + F.col("prompt_cache_miss_tokens") / 1_000_000 * F.col("miss_price")
        + F.col("completion_tokens") / 1_000_000 * F.col("out_price")
    )
    return joined.withColumns(
        {"cache_hit_rate_percent": hit_rate(F.col("prompt_cache_hit_tokens"), F.col("prompt_tokens")), "price_cny": F.coalesce(F.round(price, 8), F.lit(0.0))}
    ).drop("priced_model", "hit_price", "miss_price", "out_price")


def totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, successes, tokens, hit rate (of the sums) and price by key."""
    sums = calls.groupBy(*keys).agg(
        F.count("*").alias("api_call_count"),
        F.count_if(F.col("status") == "success").alias("api_success_count"),
        F.count_if(~F.col("status").eqNullSafe("success")).alias("api_paused_count"),
        *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in TOKENS),
        F.round(F.coalesce(F.sum("price_cny"), F.lit(0.0)), 8).alias("price_cny"),
    )
    return sums.withColumn("cache_hit_rate_percent", hit_rate(F.col("prompt_cache_hit_tokens"), F.col("prompt_tokens")))


def rolled_up(steps: DataFrame, *keys: str) -> DataFrame:
    """Step totals summed once more, for the whole operation."""
    sums = steps.groupBy(*keys).agg(
        F.sum("api_call_count").alias("api_call_count"), *(F.sum(k).alias(k) for k in TOKENS), F.round(F.sum("price_cny"), 8).alias("price_cny")
    )
    return sums.withColumn("cache_hit_rate_percent", hit_rate(F.col("prompt_cache_hit_tokens"), F.col("prompt_tokens")))


def shown_price(price: Column) -> Column:
    return F.when(price >= 0.01, F.format_string("¥%.4f", price)).otherwise(F.format_string("¥%.6f", price))


def shown_percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value)


def shown_milliseconds(value: Column) -> Column:
    return F.when(value >= 1000, F.format_string("%.2fs", value / 1000)).otherwise(F.format_string("%.0fms", value))


def shown_seconds(value: Column) -> Column:
    minutes = F.floor(value / 60)
    return F.when(value >= 60, F.format_string("%d分%.0f秒", minutes, value - minutes * 60)).otherwise(F.format_string("%.2fs", value))
