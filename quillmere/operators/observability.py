"""Operational metrics of a trace table: counters, histograms, rates, quantiles, alerts, in batch.

Windows are expressed with window(); the streaming forms in quillmere.streaming use the same pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Buckets, and the alerts' bounds.
LATENCY_BUCKETS = (0.5, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 60)
RETRIEVAL_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10)
CHUNK_BUCKETS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
P95_SECONDS, ERROR_RATIO, FALLBACK_RATIO, COST_INCREASE = 6.0, 0.05, 0.20, 1.0
PENDING_MINUTES, RING = 5, 500


def metric_rows(traces: DataFrame) -> DataFrame:
    """traces (ts, prompt_version, refusal, input_tokens, output_tokens, cost_usd, error_labels, fallback_hop,
    cache_result, model_provider, model_name) -> (ts, metric, label, value), the increments of each trace."""
    row = lambda m, label, v: F.struct(F.lit(m).alias("metric"), label.cast("string").alias("label"), v.cast("double").alias("value"))
    one = F.lit(1.0)
    single = F.array(
        row("requests", F.concat_ws("|", "prompt_version", F.col("refusal").cast("string")), one),
        row("tokens", F.lit("input"), F.col("input_tokens")),
        row("tokens", F.lit("output"), F.col("output_tokens")),
        row("cost_usd", F.lit(""), F.col("cost_usd")),
        F.when(F.col("fallback_hop").isNotNull() & ~F.col("fallback_hop").isin("primary", "n/a"), row("fallback", F.col("fallback_hop"), one)),
        F.when(F.col("cache_result").isNotNull(), row("cache", F.col("cache_result"), one)),
        row("usage", F.concat_ws("|", "model_provider", "model_name"), one),
    )
    errors = F.transform(F.coalesce("error_labels", F.array().cast("array<string>")), lambda e: row("errors", e, one))
    return traces.select("ts", F.explode(F.filter(F.concat(single, errors), lambda r: r.isNotNull())).alias("r")).select("ts", "r.*")


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "label").agg(F.sum("value").alias("value"))


def buckets(value: Column, bounds: tuple[float, ...]) -> Column:
    """Array of cumulative bucket counts as an aggregate; the last bucket is +Inf."""
    return F.array(*(F.sum(F.when(value <= float(b), 1).otherwise(0)) for b in bounds), F.count(value))


def quantile(counts: Column, bounds: tuple[float, ...], q: float) -> Column:
    """Linear interpolation inside cumulative buckets; beyond the last bound it is that bound, null if empty."""
    les = F.array(*(F.lit(float(b)) for b in bounds))
    total = F.get(counts, len(bounds)).cast("double")
    target = total * q
    at = F.size(F.filter(F.slice(counts, 1, len(bounds)), lambda c: c < target))
    low, below = F.coalesce(F.when(at > 0, F.get(les, at - 1)), F.lit(0.0)), F.coalesce(F.when(at > 0, F.get(counts, at - 1)), F.lit(0)).cast("double")
    inside = low + (F.get(les, at) - low) * (target - below) / (F.get(counts, at).cast("double") - below)
    return F.when(total == 0, F.lit(None).cast("double")).when(at >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside)


def request_histograms(rows: DataFrame, *by: str) -> DataFrame:
    """rows (by..., retrieval_s, n_chunks) -> (by..., retrieval, chunks: cumulative bucket counts, retrieval_p95, chunks_p50)."""
    h = rows.groupBy(*by).agg(buckets(F.col("retrieval_s"), RETRIEVAL_BUCKETS).alias("retrieval"), buckets(F.col("n_chunks"), CHUNK_BUCKETS).alias("chunks"))
    return h.select(*by, "retrieval", "chunks", quantile(F.col("retrieval"), RETRIEVAL_BUCKETS, 0.95).alias("retrieval_p95"), quantile(F.col("chunks"), CHUNK_BUCKETS, 0.5).alias("chunks_p50"))


def sliding(rows: DataFrame, length: str, slide: str | None = None, ts: str = "ts") -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def rates(rows: DataFrame, length: str = "15 minutes", slide: str = "1 minute", seconds: float = 900.0) -> DataFrame:
    """(window start, metric, label, increase, rate a second)."""
    w = rows.groupBy(F.window("ts", length, slide).alias("w"), "metric", "label").agg(F.sum("value").alias("increase"))
    return w.select(F.col("w.start").alias("start"), "metric", "label", "increase", (F.col("increase") / seconds).alias("rate"))


def window_stats(traces: DataFrame, length: str = "15 minutes", slide: str | None = "1 minute", of: tuple[str, ...] = ()) -> DataFrame:
    """traces (of..., ts, latency_s, n_errors, fallback, cost_usd) -> per window (and service or the like in of): requests, p95, ratios, cost.

    Ratios divide rates a second, and the rate of requests counts as one at least."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = traces.groupBy(*of, span.alias("w")).agg(F.count("*").alias("requests"), buckets(F.col("latency_s"), LATENCY_BUCKETS).alias("b"), F.sum("n_errors").alias("errors"), F.sum(F.col("fallback").cast("int")).alias("fallbacks"), F.sum("cost_usd").alias("cost"))
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    ratio = lambda x: (F.col(x) / seconds) / F.greatest(F.col("requests") / seconds, F.lit(1.0))
    return g.select(*of, F.col("w.start").alias("start"), "requests", quantile(F.col("b"), LATENCY_BUCKETS, 0.95).alias("p95"), ratio("errors").alias("error_ratio"), ratio("fallbacks").alias("fallback_ratio"), "cost")


def conditions() -> dict[str, Column]:
    """What each alert asks of a window; the first three must hold for a time before they fire."""
    return {"high_p95": F.col("p95") > P95_SECONDS, "high_errors": F.col("error_ratio") > ERROR_RATIO, "high_fallback": F.col("fallback_ratio") > FALLBACK_RATIO, "cost_spike": F.col("cost") > COST_INCREASE}


def alerts(stats: DataFrame, by: str = "start", pending: int = PENDING_MINUTES, of: tuple[str, ...] = ()) -> DataFrame:
    """Flags of each window (of each service or the like in of); the first three need to hold in every window of the last pending ones.

    Windows are dealt by spans of time; a window also goes to the next span if windows there look back on it, so no task orders all of them."""
    seconds, span = F.unix_timestamp(by), max(3600, 60 * pending)
    own = F.floor(seconds / span)
    spans = F.when(F.floor((seconds + 60 * pending) / span) > own, F.array(own, own + 1)).otherwise(F.array(own))
    flags = {name: F.coalesce(c, F.lit(False)).cast("int") for name, c in conditions().items()}
    dealt = stats.select(*of, by, own.alias("_own"), F.explode_outer(spans).alias("_span"), *(c.alias(name) for name, c in flags.items()))
    held = Window.partitionBy(*of, "_span").orderBy(F.unix_timestamp(by)).rangeBetween(-60 * pending, 0)
    always = [(F.min(name).over(held) == 1).alias(name) for name in flags if name != "cost_spike"]
    return dealt.select(*of, by, "_own", "_span", *always, (F.col("cost_spike") == 1).alias("cost_spike")).where("_own <=> _span").drop("_own", "_span")


def data_age_days(version: Column, today: Column) -> Column:
    """Days since the date of a data version (data_YYYYMMDD); null for another form."""
    date = F.regexp_extract(version, r"^data_(\d{8})$", 1)
    return F.datediff(today, F.try_to_date(F.nullif(date, F.lit("")), "yyyyMMdd"))


def recent(traces: DataFrame, n: int = RING) -> DataFrame:
    """The last n traces, what a ring buffer of that size holds."""
    return traces.orderBy(F.desc("ts"), F.desc("trace_id")).limit(n)
