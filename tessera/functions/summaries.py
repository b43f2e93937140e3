"""Columns that shape and judge summaries: tiers, flat texts, citations, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a text that name its severity, and the rank of each severity.
SEVERITY_WORDS = {
    "critical": 4, "severe": 4, "dangerous": 4, "high": 3, "significant": 3, "major": 3, "moderate": 2, "minor": 1, "low": 1, "slight": 1,
}
RANKS = ("none", "low", "moderate", "high", "critical")


def complexity(codes: Column, anomalies: Column, clues: Column, followed: Column) -> Column:
    """struct(tier, n_codes, severity, n_clues) of a flat summary: tier 3 after a diagnosis, 2 for four codes or a critical
    anomaly, 1 for two codes or a high one, else 0. Anomalies without any word of severity are moderate."""
    text = F.lower(F.trim(F.coalesce(anomalies, F.lit(""))))
    worst = F.greatest(F.lit(2), *[F.when(text.rlike(rf"\b{w}\b"), r).otherwise(2) for w, r in SEVERITY_WORDS.items() if r > 2])
    rank = F.when(text.isin("", "none", "n/a", "no anomalies", "no anomaly"), 0).otherwise(worst)
    n = F.size(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(codes, F.lit(""))), F.lit(r"[PCBU]\d{4}"), F.lit(0))))
    said = F.trim(F.coalesce(clues, F.lit("")))
    tags = F.array_distinct(F.regexp_extract_all(said, F.lit(r"(?:STAT|RULE)_\d+"), F.lit(0)))
    parts = F.size(F.filter(F.split(said, "[;\n]"), lambda p: F.trim(p) != ""))
    n_clues = F.when(said == "", 0).when(F.size(tags) > 0, F.size(tags)).otherwise(parts)
    tier = F.when(followed, 3).when((n > 3) | (rank == 4), 2).when((n > 1) | (rank >= 3), 1).otherwise(0)
    name = F.element_at(F.array(*[F.lit(r) for r in RANKS]), rank + 1)
    return F.struct(tier.alias("tier"), n.alias("n_codes"), name.alias("severity"), n_clues.alias("n_clues"))


def overridden(tier: Column, force_oneshot: bool = False, force_agent: bool = False) -> Column:
    """struct(use_agent, most_steps) of a tier; one answer can be forced, or else the agent."""
    agent = tier > 0
    steps = F.element_at(F.array(F.lit(0), F.lit(5), F.lit(15), F.lit(10)), tier + 1)
    if force_oneshot:
        agent, steps = F.lit(False), F.lit(0)
    elif force_agent:
        agent, steps = F.lit(True), F.when(tier > 0, steps).otherwise(5)
    return F.struct(agent.alias("use_agent"), steps.alias("most_steps"))


def _or_none(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("None")


def flattened(summaries: DataFrame) -> DataFrame:
    """summaries(session, start, end, seconds, n, codes array, pids array of (name, min, max, mean, latest, unit), events array of
    (severity, pattern, context, signals, score), clues array of (severity, rule, clue, evidence)) as flat texts. The
    search text names codes and clues, else anomalies, else signals that vary, else a general question."""
    f2 = lambda c: F.format_string("%.2f", c)
    pids = F.transform("pids", lambda p: F.concat(p["name"], F.lit(": min="), p["min"].cast("string"), F.lit(" max="), p["max"].cast("string"), F.lit(" mean="), f2(p["mean"]), F.lit(" latest="), p["latest"].cast("string"), F.lit(" "), p["unit"]))
    events = F.transform("events", lambda e: F.concat(F.lit("["), F.upper(e["severity"]), F.lit("] "), e["pattern"], F.lit(" (context: "), e["context"], F.lit(", signals: "), F.array_join(e["signals"], ", "), F.lit(", score: "), f2(e["score"]), F.lit(")")))
    clues = F.transform("clues", lambda c: F.concat(F.lit("["), F.upper(c["severity"]), F.lit("] "), c["rule"], F.lit(": "), c["clue"], F.lit(" (evidence: "), F.array_join(c["evidence"], "; "), F.lit(")")))
    some = lambda c: F.size(c) > 0
    by_code = F.when(some("codes"), F.concat(F.lit("DTC codes: "), F.array_join("codes", " ")))
    by_clue = F.when(some("clues"), F.concat(F.lit("Diagnostic clues: "), F.array_join(F.slice(F.transform("clues", lambda c: c["clue"]), 1, 5), "; ")))
    first = F.nullif(F.concat_ws(" | ", by_code, by_clue), F.lit(""))
    by_event = F.when(some("events"), F.concat(F.lit("Anomalies: "), F.array_join(F.slice(F.transform("events", lambda e: e["pattern"]), 1, 5), "; ")))
    varying = F.transform(F.filter("pids", lambda p: p["min"] != p["max"]), lambda p: p["name"])
    by_pid = F.when(some(varying), F.concat(F.lit("PID fluctuations: "), F.array_join(varying, " ")))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    span = F.concat(at("start"), F.lit(" to "), at("end"), F.lit(", "), F.col("seconds").cast("string"), F.lit("s, "), F.col("n").cast("string"), F.lit(" samples"))
    return summaries.select(
        "session", span.alias("time_range"), F.when(some("codes"), F.array_join("codes", ", ")).otherwise("None").alias("codes"), _or_none(pids).alias("pids"), _or_none(events).alias("events"),
        _or_none(clues).alias("clues"), F.coalesce(first, by_event, by_pid, F.lit("general OBD vehicle health check")).alias("rag_query"),
    )


def compacted(turns: DataFrame, threshold: int, keep: int = 2, snippet: int = 80, overhead: int = 4) -> DataFrame:
    """turns(conv_id, turn, role, text, calls_tools) of a conversation estimated at more tokens than ``threshold`` and with more
    than ``keep`` steps: its first two turns, a summary of the older steps as one turn, and the turns of the last ``keep`` steps.
    Other conversations stay as they are."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    assistant, calls = F.col("role") == "assistant", F.coalesce("calls_tools", F.lit(False))
    tokens = overhead + F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    x = turns.withColumn("nth", F.row_number().over(order)).withColumn("mark", F.sum(assistant.cast("int")).over(order))
    x = x.withColumn("opens", (assistant & calls).cast("int")).withColumn("in_step", F.max(F.when(assistant, calls)).over(Window.partitionBy("conv_id", "mark")))
    x = x.withColumn("in_step", F.coalesce("in_step", F.lit(False))).withColumn("step", F.when(F.col("in_step"), F.sum("opens").over(order)))
    whole = Window.partitionBy("conv_id")
    x = x.withColumn("tokens", F.sum(tokens).over(whole)).withColumn("steps", F.coalesce(F.max("step").over(whole), F.lit(0)))
    cut = (F.col("tokens") > threshold) & (F.col("steps") > keep)
    old = F.col("step") <= F.col("steps") - keep
    kept = x.where(~cut | (F.col("nth") <= 2) | (F.col("step").isNotNull() & ~old))
    kept = kept.select("conv_id", F.when(cut & (F.col("nth") > 2), F.col("nth") + 1).otherwise(F.col("nth")).alias("place"), "role", "text")
    said = F.when(F.length("text") > snippet, F.concat(F.substring("text", 1, snippet), F.lit("..."))).otherwise(F.coalesce("text", F.lit("")))
    results = x.where(cut & old & (F.col("opens") == 0)).groupBy("conv_id", "step").agg(F.array_sort(F.collect_list(F.struct("nth", said.alias("s")))).alias("r"))
    steps = x.where(cut & old & (F.col("opens") == 1)).select("conv_id", "step").join(results, ["conv_id", "step"], "left")
    line = F.concat(F.lit("- Iter "), F.col("step").cast("string"), F.lit(": "), F.coalesce(F.array_join(F.transform("r", lambda r: F.concat(F.lit("tool -> "), r["s"])), ", "), F.lit("tool")))
    lines = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("[Compacted] Prior iterations summary:\n"), F.array_join(F.transform("l", lambda l: l["line"]), "\n"))
    summary = lines.select("conv_id", F.lit(2.5).alias("place"), F.lit("assistant").alias("role"), text.alias("text"))
    return kept.withColumn("place", F.col("place").cast("double")).unionByName(summary)


def json_ready(columns: dict[str, Column]) -> Column:
    """an object of the columns: NaN as null, times in ISO form, nulls kept."""
    fields = [F.when(~F.isnan(c), c).alias(k) if k.startswith("d_") else c.alias(k) for k, c in columns.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def cited(answer: Column, citations: Column) -> Column:
    """an answer with its citations (manual_id, slug, quote) as a numbered list."""
    lines = F.transform(citations, lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), c["manual_id"], F.lit("#"), c["slug"], F.coalesce(F.concat(F.lit(' "'), c["quote"], F.lit('"')), F.lit(""))))
    return F.when(F.size(citations) > 0, F.concat(answer, F.lit("\n\nSources:\n"), F.array_join(lines, "\n"))).otherwise(answer)


def model_ladder(override: Column, body: Column, filename: Column, model_of) -> Column:
    """F16: a given model, else one named in the first 5,000 letters of the text (that far and no farther: the cover), else in the
    file's name, else that name without its marks if it is no UUID and has a digit, else Generic."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(stem, r"[_\s]+", " "))
    uuid = stem.rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")
    known = lambda c: F.nullif(model_of(c), F.lit("Generic"))
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), known(F.substring(body, 1, 5000)), known(filename), F.when(~uuid & clean.rlike(r"\d"), clean), F.lit("Generic"))


def first_alias(title: Column, aliases: dict[str, list[str]], otherwise: str = "general") -> Column:
    """the subsystem with the longest alias in a title, case aside; on a tie the first in order of name."""
    pairs = [(len(a), name, a.lower()) for name, words in aliases.items() for a in words]
    found = F.array(*[F.when(F.contains(F.lower(title), F.lit(a)), F.struct(F.lit(-n).alias("n"), F.lit(name).alias("name"))) for n, name, a in pairs])
    return F.coalesce(F.array_min(F.filter(found, lambda f: f.isNotNull()))["name"], F.lit(otherwise))


def first_pattern(title: Column, patterns: list[tuple[str, str]], otherwise: str = "section") -> Column:
    """the type of the first pattern that a title fits."""
    return F.coalesce(*[F.when(title.rlike(p), kind) for p, kind in patterns], F.lit(otherwise))


def augmented_code_rows(lines: DataFrame, cards: DataFrame) -> DataFrame:
    """lines of a document with the slug of cards(code, slug) that each table row's first code has, or NOT-INDEXED, as a last cell."""
    code = F.upper(F.regexp_extract("line", r"(?i)\b[PCBU]\d[0-9A-F]{3}\b", 0))
    x = lines.withColumn("code", F.when(F.col("line").rlike(r"^\s*\|") & (code != ""), code)).join(cards, "code", "left")
    cell = F.concat(F.regexp_replace("line", r"\s*$", ""), F.lit(" "), F.coalesce("slug", F.lit("NOT-INDEXED")), F.lit(" |"))
    return x.select("id", "line_no", F.when(F.col("code").isNotNull(), cell).otherwise(F.col("line")).alias("line"))


def canonical_name(maker: Column, model: Column) -> Column:
    """maker and model, or what there is of them."""
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(maker), F.lit("")), F.nullif(F.trim(model), F.lit(""))), F.lit(""))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
