"""Metrics of answers against goldens, each as joins and grouped counts over exploded rows.

Slugs and terms are rows (entry, slug); an entry without rows of a kind has an empty set of it.
``entries(entry)`` names all entries. A metric that does not apply is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import texts as X

# Weights of the overall score.
WEIGHTS = {
    "section_recall": 0.25, "claim_precision": 0.10, "exploration_cost": 0.0, "fact_recall": 0.20, "fact_density": 0.05, "hallucination_penalty": 0.15,
    "citation_quality": 0.05, "value_accuracy": 0.05, "answer_quality": 0.15,
}
BASE_TOKENS, TOKENS_A_FACT = 500, 2500
# The kinds of questions about signals.
SIGNAL_KINDS = ("signal_statistics", "event_finding", "dtc_enumeration", "dtc_decode", "compound_obd", "adversarial_obd")
SIGNAL_COLUMNS = {"section_recall": "signal_recall", "claim_precision": "signal_precision", "citation_quality": "code_accuracy"}


def _named(slugs: DataFrame) -> DataFrame:
    return slugs.where("slug <> ''").select("entry", "slug").distinct().withColumn("key", X.normal_slug(F.col("slug")))


def _found(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    plain = lambda c: F.lower(X.single_spaced(F.col(c)))
    q = quotes.select("entry", "slug", plain("quote").alias("q")).where("q <> ''")
    return q.join(texts.select("entry", plain("text").alias("t")), "entry").where(F.contains("t", F.col("q"))).select("entry", "slug")


def quoted(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(entry, slug) of quotes(entry, slug, quote) found in the entry's texts(entry, text), spacing and case aside."""
    return _found(quotes, texts).distinct()


def covered(expected: DataFrame, surfaced: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """The expected (entry, slug) that surfaced, in other spelling too, or of which a quote is in the text."""
    there = surfaced.where("slug <> ''").select("entry", "slug").unionByName(_found(quotes, texts))
    return _named(expected).join(there.select("entry", X.normal_slug(F.col("slug")).alias("key")), ["entry", "key"], "left_semi").select("entry", "slug")


def _marked(entries: DataFrame, **slugs: DataFrame) -> DataFrame:
    """(entry, slug, a column for each of ``slugs``): whether it has the slug, 1 or 0. Every entry has a row with a null slug besides, and
    ``listed``: slugs of other entries have it 0. One frame under several names is read once."""
    marks = ["listed", *slugs]
    frames: list = [(entries.select("entry", F.lit(None).cast("string").alias("slug")), {"listed"})]
    for name, df in slugs.items():
        same = next((own for other, own in frames if other is df), None)
        if same is None:
            frames.append((df, {name}))
        else:
            same.add(name)
    parts = [df.where("slug <> '' AND entry IS NOT NULL" if k else "true").select("entry", "slug", *[F.lit(int(m in own)).alias(m) for m in marks]) for k, (df, own) in enumerate(frames)]
    x = parts[0]
    for part in parts[1:]:
        x = x.unionByName(part)
    return x.groupBy("entry", "slug").agg(*[F.max(m).alias(m) for m in marks])


def section_metrics(entries: DataFrame, expected: DataFrame, covered_: DataFrame, claims: DataFrame, covered_claims: DataFrame) -> DataFrame:
    """(entry, section_recall, claim_precision): the share of expected slugs that are covered, and of claimed ones that
    are expected or covered by a quote only, at most all. Null without expected slugs; precision is 1 without claims."""
    x = _marked(entries, expected=expected, hit=covered_, claim=claims, quote=covered_claims)
    total = lambda c, name: F.sum(c).alias(name)
    # sums by key, then by entry: a claim counts where its key is expected, a quote where no claim does
    counts = [total("listed", "listed"), total("expected", "n_expected"), total(F.col("hit") * F.col("expected"), "n_hits"), total("claim", "n_claims"), total("quote", "n_quoted")]
    x = x.withColumn("key", X.normal_slug(F.col("slug"))).groupBy("entry", "key").agg(*counts)
    matched, both = F.when(F.col("n_expected") > 0, F.col("n_claims")).otherwise(0), (F.col("n_expected") > 0) & (F.col("n_claims") > 0)
    sums = [total(c, c) for c in ("listed", "n_expected", "n_hits", "n_claims")]
    x = x.groupBy("entry").agg(*sums, total(matched + F.when(both, 0).otherwise(F.col("n_quoted")), "n_correct")).where("listed > 0")
    precision = F.when(F.col("n_claims") == 0, 1.0).otherwise(F.least("n_claims", "n_correct") / F.nullif("n_claims", F.lit(0)))
    return x.select("entry", F.when(F.col("n_expected") > 0, F.col("n_hits") / F.col("n_expected")).alias("section_recall"), F.when(F.col("n_expected") > 0, precision).alias("claim_precision"))


def exploration_cost(entries: DataFrame, reads: DataFrame, claims: DataFrame) -> DataFrame:
    """(entry, exploration_cost): the share of slugs read that are not claimed; 0 without any read."""
    x = _marked(entries, read=reads, used=claims)
    x = x.groupBy("entry").agg(F.sum("listed").alias("listed"), F.sum("read").alias("n"), F.sum(F.col("read") * F.col("used")).alias("used")).where("listed > 0")
    return x.select("entry", F.coalesce(1 - F.col("used") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("exploration_cost"))


def citation_quality(n_expected: Column, n_claims: Column, matched: Column) -> Column:
    """0, 0.3 or 1."""
    return F.when(n_expected == 0, F.when(n_claims == 0, 1.0).otherwise(0.3)).when(n_claims == 0, 0.0).otherwise(F.when(matched, 1.0).otherwise(0.3))


def trajectory_efficiency(expected: Column, actual: Column) -> Column:
    """Expected calls over actual ones, at most 1; 1 where either is none."""
    return F.when((expected <= 0) | (actual <= 0), 1.0).otherwise(F.least(F.lit(1.0), expected / F.greatest(actual, expected)))


def fact_recall(terms: DataFrame, texts: DataFrame, equivalents: DataFrame | None = None) -> DataFrame:
    """(entry, n_terms, n_hits, fact_recall) of terms(entry, term) in the entry's text: as written, with any white space
    within a term that has CJK letters, or in an equivalent(term, other) wording. Only entries with terms."""
    plain = lambda c: F.lower(X.single_spaced(F.col(c)))
    t = terms.groupBy("entry", "term").agg(F.count("*").alias("n")).withColumn("word", plain("term"))
    wordings = t.select("entry", "term", "n", "word")
    if equivalents is not None:
        others = equivalents.select(X.normal_slug(F.col("term")).alias("key"), plain("other").alias("other"))
        wordings = wordings.unionByName(t.withColumn("key", X.normal_slug(F.col("word"))).join(others, "key").select("entry", "term", "n", F.col("other").alias("word")))
    x = wordings.join(texts.select("entry", plain("text").alias("text")), "entry", "left")
    loose = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    there = F.contains("text", F.col("word")) | (F.col("word").rlike(f"[{X.IDEOGRAPHS}]") & F.contains(loose("text"), loose("word")))
    hits = x.groupBy("entry", "term", "n").agg(F.max(F.coalesce((F.col("word") != "") & there, F.lit(False)).cast("int")).alias("hit"))
    return hits.groupBy("entry").agg(F.sum("n").alias("n_terms"), F.sum(F.col("hit") * F.col("n")).alias("n_hits")).withColumn("fact_recall", F.col("n_hits") / F.col("n_terms"))


def fact_density(n_hits: Column, n_terms: Column, tokens: Column) -> Column:
    """E5: recall, less where the text is longer than its terms warrant; 0 without text or terms."""
    budget = BASE_TOKENS + TOKENS_A_FACT * n_terms
    return F.when((n_terms > 0) & (tokens > 0), n_hits / F.nullif(n_terms, F.lit(0)) * F.least(F.lit(1.0), budget / F.greatest(tokens, F.lit(1)))).otherwise(0.0)


def hallucination_penalty(violations: Column) -> Column:
    """E6."""
    return F.greatest(F.lit(0.1), 1 - 0.3 * F.greatest(violations, F.lit(0)))


def overall(rows: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Rows with ``overall``, the weighted sum of their metrics in 0..1; the weight of null metrics goes to the others."""
    score = sum(((1 - F.col(k)) if k == "exploration_cost" else F.coalesce(k, F.lit(0.0))) * w for k, w in weights.items())
    missing = sum(F.when(F.col(k).isNull(), weights[k]).otherwise(0.0) for k in ("section_recall", "claim_precision"))
    total = sum(weights.values())
    scaled = F.when((missing > 0) & (total - missing > 0), score * total / F.nullif(total - missing, F.lit(0.0))).otherwise(score)
    return rows.withColumn("overall", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def by_lane(rows: DataFrame, kind: str = "question_type", signal_kinds: tuple = SIGNAL_KINDS) -> DataFrame:
    """Rows with the metrics of their lane in the columns that ``overall`` weighs. Questions of ``signal_kinds`` put signal_recall,
    signal_precision and code_accuracy in the place of section_recall, claim_precision and citation_quality, and cost and trajectory have
    their neutral values; all others, and those of no kind, keep their own and have a neutral value_accuracy. The facts' metrics are the same in both
    lanes. A column that the rows lack counts as null; the signal columns are dropped; other columns stay."""
    of_signals = F.coalesce(F.col(kind).isin(*signal_kinds), F.lit(False))
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    out = {own: F.when(of_signals, get(other)).otherwise(get(own)) for own, other in SIGNAL_COLUMNS.items()}
    out |= {name: F.when(of_signals, value).otherwise(get(name)) for name, value in (("exploration_cost", 0.0), ("trajectory_efficiency", 1.0))}
    out["value_accuracy"] = F.when(of_signals, get("value_accuracy")).otherwise(1.0)
    return rows.withColumns(out).drop(*SIGNAL_COLUMNS.values())


def signal_metrics(entries: DataFrame, expected: DataFrame, cited: DataFrame) -> DataFrame:
    """(entry, signal_recall, signal_precision, value_accuracy) of expected(entry, signal, stat, value, tolerance,
    start, end) and cited(entry, signal, stat, value, start, end). A citation matches if the signal is the same but for case, the
    statistic too where one is expected, and the open intervals overlap where one is expected. ``entries(entry, no_evidence)``:
    where no evidence is expected, both are 1 without a citation and else 0."""
    e = expected.withColumn("eid", F.monotonically_increasing_id()).withColumn("key", F.lower("signal"))
    c = cited.select("entry", F.lower("signal").alias("key"), F.col("stat").alias("c_stat"), F.col("value").alias("c_value"), F.col("start").alias("c_start"), F.col("end").alias("c_end")).withColumn("cid", F.monotonically_increasing_id())
    same_stat = F.col("stat").isNull() | F.coalesce(F.col("stat") == F.col("c_stat"), F.lit(False))
    in_time = F.col("start").isNull() | F.coalesce((F.col("start") < F.col("c_end")) & (F.col("c_start") < F.col("end")), F.lit(False))
    pairs = e.join(c, ["entry", "key"]).where(same_stat & in_time)
    near = F.when(F.col("value") == 0, F.abs("c_value") <= 0.01).otherwise(F.abs(F.col("c_value") - F.col("value")) <= F.abs("value") * F.col("tolerance"))
    compared = F.col("value").isNotNull() & F.col("c_value").isNotNull()
    found = pairs.groupBy("entry").agg(
        F.countDistinct("eid").alias("e_hits"), F.countDistinct("cid").alias("c_hits"), F.count(F.when(compared, 1)).alias("n_compared"), F.count(F.when(compared & near, 1)).alias("n_near"),
    )
    x = entries.select("entry", "no_evidence").distinct()
    for df in (e.groupBy("entry").agg(F.count("*").alias("n_e")), c.groupBy("entry").agg(F.count("*").alias("n_c")), found):
        x = x.join(df, "entry", "left")
    x = x.na.fill(0, ["n_e", "n_c", "e_hits", "c_hits", "n_compared", "n_near"])
    none = F.when(F.col("n_c") == 0, 1.0).otherwise(0.0)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(1.0))
    precision = F.when(F.col("n_e") == 0, 1.0).otherwise(share("c_hits", "n_c"))
    return x.select(
        "entry", F.when(F.col("no_evidence"), none).otherwise(share("e_hits", "n_e")).alias("signal_recall"), F.when(F.col("no_evidence"), none).otherwise(precision).alias("signal_precision"),
        F.when(F.col("no_evidence"), 1.0).otherwise(share("n_near", "n_compared")).alias("value_accuracy"),
    )


def code_accuracy(entries: DataFrame, expected: DataFrame, cited: DataFrame) -> DataFrame:
    """(entry, code_accuracy): matched codes over all, as a Jaccard share. A match has the same code but for case, and
    the same status where one is expected."""
    e = expected.withColumn("eid", F.monotonically_increasing_id()).withColumn("key", F.lower("code"))
    c = cited.select("entry", F.lower("code").alias("key"), F.col("status").alias("c_status")).withColumn("cid", F.monotonically_increasing_id())
    pairs = e.join(c, ["entry", "key"]).where(F.col("status").isNull() | F.coalesce(F.col("status") == F.col("c_status"), F.lit(False)))
    found = pairs.groupBy("entry").agg(F.countDistinct("eid").alias("a"), F.countDistinct("cid").alias("b"))
    x = entries.select("entry", "no_evidence").distinct()
    for df in (e.groupBy("entry").agg(F.count("*").alias("n_e")), c.groupBy("entry").agg(F.count("*").alias("n_c")), found):
        x = x.join(df, "entry", "left")
    x = x.na.fill(0, ["n_e", "n_c", "a", "b"])
    both = F.least("a", "b")
    value = F.when(F.col("no_evidence"), F.when(F.col("n_c") == 0, 1.0).otherwise(0.0)).when(F.col("n_e") == 0, 1.0)
    return x.select("entry", F.coalesce(value, both / F.nullif(F.col("n_e") + F.col("n_c") - both, F.lit(0)), F.lit(1.0)).alias("code_accuracy"))


def grounded(candidates: DataFrame, required: list[str], quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(entry, complete, n_quotes, n_found, accepted): whether a candidate has all required fields, and whether each of
    its quotes(entry, slug, quote), one at least, is in the text that it cites, texts(slug, text)."""
    full = F.lit(True)
    for c in required:
        full = full & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    plain = lambda c: F.lower(X.single_spaced(F.col(c)))
    q = quotes.select("entry", "slug", plain("quote").alias("q")).join(texts.select("slug", plain("text").alias("t")), "slug", "left")
    found = q.groupBy("entry").agg(F.count("*").alias("n_quotes"), F.count(F.when((F.col("q") != "") & F.contains("t", F.col("q")), 1)).alias("n_found"))
    x = candidates.select("entry", full.alias("complete")).join(found, "entry", "left").na.fill(0, ["n_quotes", "n_found"])
    return x.withColumn("accepted", F.col("complete") & (F.col("n_quotes") > 0) & (F.col("n_quotes") == F.col("n_found")))


def promotable(entries: DataFrame, reviews: DataFrame, locked: DataFrame, least_stars: int = 4) -> DataFrame:
    """entries(entry, manual_id) that may be locked: not locked yet, cited by a UUID, and their latest graded
    review(entry, at, verdict, stars) accepts them with ``least_stars`` or more."""
    graded = reviews.where("verdict IS NOT NULL AND stars IS NOT NULL").groupBy("entry").agg(F.max_by(F.struct("verdict", "stars"), F.struct("at", "verdict", "stars")).alias("r"))
    good = graded.where((F.col("r.verdict") == "accept") & (F.col("r.stars") >= least_stars)).select("entry")
    return entries.where(F.col("manual_id").rlike(f"^{X.UUID}$")).join(good, "entry", "left_semi").join(locked.select("entry"), "entry", "left_anti")


def dimension_means(rows: DataFrame, lane: str, dimensions: list[str]) -> DataFrame:
    """(lane, dimension, mean, n): the mean of each dimension, without null and NaN."""
    x = rows.select(lane, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in dimensions])).alias("d")).select(lane, "d.*")
    v = F.when(~F.isnan("v"), F.col("v"))
    return x.groupBy(lane, "dimension").agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def threshold(mean: Column, std: Column) -> Column:
    """Mean less a sample deviation, down to one decimal."""
    return F.floor((mean - std) * 10) / 10
