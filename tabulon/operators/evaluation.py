"""Comparison of decisions and ratings across variants: E1-E10."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.expressions import canonical, canonical_set
from tabulon.functions.numbers import correlations, paired_corr
from tabulon.operators.clean import first_per_key
from tabulon.session import keyed, spread
from tabulon.operators.reshape import join_baseline, pivot_mean, row_min, same_set, subset

#: Variant rows that one task joins and averages, of a few hundred bytes each.
TASK_ROWS = 1_000_000
LIST_FIELDS = ("filters", "columns", "prepare", "aggregate")


def component_matches(variants: DataFrame, base: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Per variant row 1/0 for each component and for all of them; null equals null."""
    both = join_baseline(keyed(variants, keys, TASK_ROWS), base, keys, components)
    hits = {f"match_{c}": F.col(c).eqNullSafe(F.col(f"{c}_base")).cast("double") for c in components}
    both = both.withColumns(hits)
    return both.withColumn("match_all", row_min(list(hits)))


def stability(matches: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Mean match per system and id."""
    return matches.groupBy(*keys).agg(*[F.avg(f"match_{c}").alias(f"match_{c}") for c in [*components, "all"]])


def match_rates(stable: DataFrame, system: str, components: list[str], systems: list, min_n: int = 30) -> DataFrame:
    """Exact-match rate in percent, component x system, groups of at least ``min_n``."""
    values = [f"match_{c}" for c in components]
    long = stable.select(system, *values).unpivot([system], values, "component", "match")
    rates = long.groupBy("component", system).agg(F.avg("match").alias("rate"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    named = rates.select(F.substr(F.col("component"), F.lit(7)).alias("component"), system, (100.0 * F.col("rate")).alias("rate_pct"))
    return pivot_mean(named, ["component"], system, "rate_pct", systems)


def full_stability(stable: DataFrame, system: str, min_n: int = 30) -> DataFrame:
    """Share of complete matches per system."""
    return stable.groupBy(system).agg(
        (100.0 * F.avg("match_all")).alias("rate_pct"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= min_n)


def normalize_decisions(log: DataFrame) -> DataFrame:
    """Canonical family and type and canonical list fields next to the originals."""
    log = spread(log)
    texts = {f"{c}_n": canonical(c) for c in ("family", "type")}
    return log.withColumns(texts | {f"{c}_n": canonical_set(c) for c in LIST_FIELDS})


def compare_to_baseline(log: DataFrame, baseline: str = "base", key: str = "id", variant: str = "variant", order_by: list[str] | None = None) -> DataFrame:
    """Every row with missing-field text and five flags against the baseline row of its id.

    ``log`` holds the normalised fields (``family_n`` ... ``aggregate_n``). Ids without a baseline
    are marked ``baseline_missing``; of several baseline rows the first one counts.
    """
    fields = ["family_n", "type_n", *[f"{c}_n" for c in LIST_FIELDS]]
    base_rows = log.filter(F.col(variant) == baseline).select(key, *(order_by or []), *fields)
    base = first_per_key(base_rows, [key], order_by or []).select(key, *fields)
    both = join_baseline(log, base, [key], fields, check=False)

    def b(c: str) -> Column:
        return F.col(f"{c}_base")

    is_base = F.col(variant) == baseline
    lost = F.concat_ws(", ", *[
        F.when(~subset(b(f"{c}_n"), F.col(f"{c}_n")), F.lit(c)) for c in ("filters", "prepare", "aggregate", "columns")
    ])
    flags = {
        "same_family_type": (F.col("family_n") == b("family_n")) & (F.col("type_n") == b("type_n")),
        "same_filters": same_set(F.col("filters_n"), b("filters_n")),
        "columns_include_base": subset(b("columns_n"), F.col("columns_n")),
        "same_prepare_aggregate": same_set(F.col("prepare_n"), b("prepare_n")) & same_set(F.col("aggregate_n"), b("aggregate_n")),
    }
    have = F.col("has_base")
    out = both.withColumn("missing_fields", F.when(~have, F.lit("baseline_missing")).when(is_base, F.lit("")).otherwise(lost))
    out = out.withColumns({n: F.coalesce(have & (is_base | c), F.lit(False)) for n, c in flags.items()})
    all_ok = F.col("same_family_type") & F.col("same_filters") & F.col("columns_include_base") & F.col("same_prepare_aggregate")
    return out.withColumn("all_three_ok", all_ok).drop("has_base", *[f"{c}_base" for c in fields])


FLAGS = ("same_family_type", "same_filters", "columns_include_base", "same_prepare_aggregate", "all_three_ok")


def overall_rates(compared: DataFrame, baseline: str = "base", variant: str = "variant") -> DataFrame:
    """E5: mean of every flag over the non-baseline rows."""
    alts = compared.filter(F.col(variant) != baseline)
    return alts.agg(F.count(F.lit(1)).alias("n_alts"), *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in FLAGS])


def rates_per_id(compared: DataFrame, key: str = "id", baseline: str = "base", variant: str = "variant") -> DataFrame:
    """E5: the same per id, and whether all variants match."""
    alts = compared.filter(F.col(variant) != baseline)
    per = alts.groupBy(key).agg(F.count(F.lit(1)).alias("n_alts"), *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in FLAGS])
    return per.withColumns({
        "all_match": F.col("rate_all_three_ok") == 1.0, "all_match_task": F.col("rate_same_family_type") == 1.0,
    })


def rate_distribution(per_id: DataFrame, rate: str = "rate_all_three_ok") -> DataFrame:
    """E5: how many ids reach each rate."""
    return per_id.groupBy(F.round(rate, 6).alias("rate")).agg(F.count(F.lit(1)).alias("n_ids"))


def missing_field_counts(compared: DataFrame, baseline: str = "base", variant: str = "variant") -> DataFrame:
    """How often each field is missing in the non-baseline rows."""
    parts = compared.filter(F.col(variant) != baseline).select(F.explode(F.split("missing_fields", ",")).alias("f"))
    return parts.select(F.trim("f").alias("field")).filter("field <> ''").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def winners(ratings: DataFrame, item: str, system: str, score: str) -> DataFrame:
    """Per item the system with the best mean, TIE when several share it; aggregates and one equi-join."""
    means = ratings.groupBy(item, system).agg(F.avg(score).alias("m"))
    best = means.groupBy(item).agg(F.max("m").alias("m"))
    top = means.join(best, [item, "m"]).groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min(system).alias("first"))
    return top.select(item, F.when(F.col("n") > 1, F.lit("TIE")).otherwise(F.col("first")).alias("winner"))


def win_counts(won: DataFrame, item: str) -> DataFrame:
    """Items per winner."""
    return won.groupBy("winner").agg(F.count_distinct(item).alias("n_items"))


def metric_group_means(ratings: DataFrame, item: str, system: str, metric: str, score: str, groups: dict[str, list[str]]) -> DataFrame:
    """Mean over the metrics of each named group per item and system; one pass for all groups."""
    member = F.array_compact(F.array(*[F.when(F.col(metric).isin(*ms), F.lit(g)) for g, ms in groups.items()]))
    return ratings.withColumn("group", F.explode(member)).groupBy("group", item, system).agg(F.avg(score).alias("value"))


def metric_correlations(ratings: DataFrame, item: str, metric: str, score: str, order: list) -> DataFrame:
    """Correlation of the metrics across items."""
    wide = pivot_mean(ratings, [item], metric, score, order)
    names = [str(m) for m in order]
    pairs = list(combinations_with_replacement(names, 2))
    rs = correlations(wide, [(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in pairs])
    one = wide.agg(*[r.alias(f"r{i}") for i, r in enumerate(rs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) if a != b]
    return one.select(F.inline(F.array(*cells)))


def feature_fits(ratings: DataFrame, item: str, system: str, metric: str, score: str, target: str, features: list[str]) -> DataFrame:
    """Per system and feature the line through the target and r, "NA" when a side is constant."""
    wide = pivot_mean(ratings, [system, item], metric, score, [*features, target])
    y = F.col(f"`{target}`")
    aggs = []
    for f in features:
        x = F.col(f"`{f}`")
        aggs.append(F.struct(
            F.lit(f).alias("feature"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), paired_corr(x, y).alias("r"),
        ).alias(f))
    per = wide.groupBy(system).agg(*aggs)
    rows = per.select(system, F.inline(F.array(*[F.col(f"`{f}`") for f in features])))
    return rows.withColumn("r_text", F.coalesce(F.format_string("%.2f", F.when(F.col("n") >= 2, F.col("r"))), F.lit("NA"))).withColumn(
        "r_text", F.when(F.col("r").isNull(), F.lit("NA")).otherwise(F.col("r_text"))
    )


def strict_columns_match(log: DataFrame, baseline: str = "base", key: str = "id", variant: str = "variant") -> DataFrame:
    """Whether the sorted column list equals that of the baseline row."""
    names = log.withColumn("__names", F.array_sort(F.col("columns_n")))
    base = first_per_key(names.filter(F.col(variant) == baseline).select(key, "__names"), [key])
    both = join_baseline(names.filter(F.col(variant) != baseline), base, [key], ["__names"], check=False)
    hit = F.coalesce(F.col("__names") == F.col("__names_base"), F.lit(False))
    return both.withColumn("columns_exact_match", hit).drop("__names", "__names_base", "has_base")
