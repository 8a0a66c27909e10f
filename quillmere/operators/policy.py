"""Query-time policies as column expressions: routing, dynamic k, refusal, confidence, compression,
prompts, budget, labels, and the deterministic stand-in for a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CONTEXT_CHARS, search_form, sentences, tokens

# Connectors, markers and thresholds.
CONNECTORS = ("và", "vừa", "cũng như", "đồng thời", "hoặc", "hay", "nhưng", "nếu.*thì")
SECOND_PERSON = ("bạn", "anh/chị", "anh chị")
BRANCHES = ("nếu", "trường hợp", "tùy", "hoặc", "còn nếu", "khác nhau")
TIERS = {"simple": "cheap", "medium": "balanced", "hard": "strong"}
HOPS = ("primary", "secondary", "tertiary", "local")
SIMPLE_CHARS, MIN_BRANCHES, NARROW, WIDE, MIN_SCORE, MIN_CHUNKS, MAX_CHARS = 60, 2, 0.3, 1.0, 1.10, 2, 800
SEPARATOR = "\n\n---\n\n"


def _whole_words(words: tuple[str, ...]) -> str:
    # Boundaries are spelled out so that the pattern means the same in RE2.
    return r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])"


def complexity(question: Column) -> Column:
    hard = F.rlike(search_form(question), F.lit(_whole_words(CONNECTORS)))
    return F.when(hard, "hard").when(F.length(question) <= SIMPLE_CHARS, "simple").otherwise("medium")


def tier(mode: Column, level: Column) -> Column:
    """A named mode as it is; auto goes by complexity."""
    known = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    return F.when(mode == "auto", F.element_at(known, level)).otherwise(mode)


def dynamic_k(scores: Column, base: Column | int, top: int = 10, least: float = MIN_SCORE) -> Column:
    """More chunks where the best score is near the least one, fewer where it is far above; scores are best first."""
    base = F.lit(base) if isinstance(base, int) else base
    margin = F.get(scores, 0) - least
    return F.when(F.size(scores) == 0, base).when(margin <= NARROW, F.least(F.lit(top), base + 3)).when(margin >= WIDE, F.greatest(F.lit(1), base - 2)).otherwise(base)


def refusal_reason(n_chunks: Column, best: Column, least: float = MIN_SCORE, chunks: int = MIN_CHUNKS) -> Column:
    """no_context before low_score, null to go on."""
    return F.when(n_chunks < chunks, "no_context").when(F.coalesce(best, F.lit(0.0)) < least, "low_score")


def confidence(refusal: Column, best: Column, valid: Column, attempted: Column, fallback: Column) -> Column:
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (best - MIN_SCORE) / MIN_SCORE))
    cited = F.when(attempted > 0, valid / attempted).otherwise(1.0)
    value = 0.5 * clamp + 0.3 * cited + 0.2 * F.when(fallback, 0.6).otherwise(1.0)
    return F.when(~refusal, F.bround(value, 2))


def compress(text: Column, query: Column, limit: int = MAX_CHARS) -> Column:
    """Over limit characters: sentences by shared query tokens, best first, until the first that
    overflows (one at least), in their old order. A fold over the ranked sentences."""
    parts, wanted = sentences(text), F.array_distinct(tokens(query, unicode=False))
    ranked = F.array_sort(F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(s, unicode=False)), wanted))).alias("by"), i.alias("pos"), s.alias("s"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<struct<pos:int,s:string>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["full"] | ((F.size(acc["kept"]) > 0) & (acc["n"] + F.length(x["s"]) > limit))
        one = F.array(F.struct(x["pos"].alias("pos"), x["s"].alias("s")))
        return F.struct(F.when(over, acc["n"]).otherwise(acc["n"] + F.length(x["s"])).alias("n"), over.alias("full"), F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"))

    kept = F.aggregate(ranked, zero, step, lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda x: x["s"]), " "))
    return F.when(F.length(text) <= limit, text).otherwise(kept)


def context(chunks: DataFrame, query: str, limit: int = CONTEXT_CHARS) -> DataFrame:
    """chunks (query, rank, chunk_id, document_id, title, section, text) -> one context text a query."""
    head = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] ("), F.concat_ws(" - ", F.coalesce("title", "document_id"), "section"), F.lit(")\n"), F.substring("text", 1, limit))
    rows = F.array_sort(F.collect_list(F.struct("rank", head.alias("t"))))
    return chunks.groupBy(query).agg(F.array_join(F.transform(rows, lambda x: x["t"]), SEPARATOR).alias("context"))


def render(template: str, **values: Column) -> Column:
    """{name} put in, {{ and }} as braces; a name without a value is an error."""
    import re

    missing = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", template)) - set(values)
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    pieces = re.split(r"(?<!\{)\{(\w+)\}(?!\})", template)
    plain = lambda x: F.lit(x.replace("{{", "{").replace("}}", "}"))
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else plain(p) for i, p in enumerate(pieces)))


def budget(traces: DataFrame, daily: float, hard_block: bool = True, order: str = "created_at", by: str | None = None) -> DataFrame:
    """Adds cumulative_cost before each trace and the tier after a downgrade; a daily budget of 0 never blocks."""
    part = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    before = part.orderBy(order, "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))
    down = (F.lit(daily) > 0) & (spent >= daily) & F.lit(hard_block) & (F.col("tier") != "cheap")
    return traces.withColumns({"spent_before": spent, "downgraded": down, "budget_warning": (F.lit(daily) > 0) & (spent + F.col("cost_usd") > daily)}).withColumn("tier", F.when(F.col("downgraded"), "cheap").otherwise(F.col("tier")))


def hop(model_group: Column) -> Column:
    out = F.lit("unknown")
    for name in HOPS:
        out = F.when(F.endswith(model_group, F.lit(f"-{name}")), name).otherwise(out)
    return out


def error_labels(parse_error: Column, invalid: Column, hop_: Column, warning: Column, downgraded: Column) -> Column:
    served = F.when(~hop_.isin("primary", "n/a", "unknown"), F.concat(F.lit("served_by_fallback:"), hop_))
    found = F.array(parse_error, F.when(F.size(invalid) > 0, "invalid_citations_dropped"), served, F.when(warning, "budget_warning"), F.when(downgraded, "budget_downgrade"))
    return F.filter(found, lambda x: x.isNotNull())


def ambiguity_handled(answer: Column) -> Column:
    asks = F.contains(answer, F.lit("?")) & F.rlike(answer, F.lit(_whole_words(SECOND_PERSON)))
    n = F.regexp_count(answer, F.lit(r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(BRANCHES) + r")(?![\p{L}\p{N}_])"))
    return asks | (n >= MIN_BRANCHES)


def mock_answer(prompt: Column) -> Column:
    """The stand-in generator: a JSON answer that cites the first chunk id of the prompt."""
    first = F.regexp_extract(prompt, r"\[(chunk_[^\]]+)\]", 1)
    cited = F.when(first == "", F.array().cast("array<string>")).otherwise(F.array(first))
    return F.to_json(F.struct(F.lit("mock").alias("answer"), cited.alias("citations"), (first == "").alias("refusal")))
