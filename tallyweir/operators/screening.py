"""Screening by a classifier's probabilities as column expressions: gates, rescue, scores, tiers, removal and demotion, splits.

Answers are maps of label to probability. What reads several rows (rescue, splits, the final order) is a ranked or aggregated frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and weights of the screening rules.
ADJACENT_LEAST, RESCUE_LEAST, RESCUE_MOST = 0.6, 0.30, 20
THIN_CHARS, THIN_CHARS_CJK = 400, 150
LABEL_WEIGHTS = {"explicit": 3.0, "partial": 1.5, "insufficient": 0.5, "contradicted": -2.0}
PROFILE_FACTOR, CORE_WEIGHT, SIZE_WEIGHT = 0.5, 2.0, 0.01
DEMOTE_LEAST, ENFORCE_LEAST, ASK_LEAST = 0.60, 0.60, 0.70
BAND = (0.40, 0.75)
SPLIT_LEAST, SPLIT_SHARE, KEEP_SHARE, OVERLAP_MOST, SPLITS_MOST = 4, 0.10, 0.20, 0.5, 2
# What a profile that does not break off ends with.
CLOSED = r"[.!?。！？)）\"”'」』]$"
# Answers that speak against a row and those that speak for it, by family.
AGAINST = {"product": ("component", "assembly_only", "adjacent"), "role": ("buyer_user", "upstream", "channel", "minority_holder", "other_link"), "target": ("other_only",)}
IN_FAVOUR = {"product": ("own",), "role": ("supplier",), "target": ("named", "one_of_several")}
# Licence tiers from the most open to the most restricted.
LICENCE_TIERS = ("official-open", "official-private", "gray-private")


def p_of(probs: Column, label: str) -> Column:
    """The probability of a label, 0 where the answer lacks it; null without an answer."""
    return F.when(probs.isNotNull(), F.coalesce(F.try_element_at(probs, F.lit(label)), F.lit(0.0)))


def p_positive(probs: Column) -> Column:
    """P(explicit) + P(partial); null without probabilities."""
    return F.when(F.size(F.map_keys(probs)) > 0, p_of(probs, "explicit") + p_of(probs, "partial"))


def passes_gate(status: Column, label: Column, probs: Column, adjacent_least: float = ADJACENT_LEAST, core_least: float = 0.0) -> Column:
    """Whether a first answer lets a row through: core of enough probability, or adjacent where core and adjacent together have enough."""
    core, adjacent = p_of(probs, "core"), p_of(probs, "adjacent")
    passed = F.when(label == "core", F.lit(core_least <= 0) | (core >= core_least)).when(label == "adjacent", core + adjacent >= adjacent_least)
    return F.coalesce(F.when(status == "ok", passed), F.lit(False))


def is_thin(text: Column) -> Column:
    """Whether a profile is too short to judge from, or breaks off: no text, under 400 characters (150 where a third is CJK), an ellipsis or no closing mark at its end."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    cjk = F.length(t) - F.length(F.regexp_replace(t, r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]+", ""))
    least = F.when(cjk * 3 > F.length(t), THIN_CHARS_CJK).otherwise(THIN_CHARS)
    return (F.length(t) < least) | t.rlike(r"(?:…|\.\.\.)$") | ~t.rlike(CLOSED)


def rescue_score(status: Column, probs: Column, text: Column) -> Column:
    """How far a first answer leans towards a match: core and adjacent, and insufficient where the profile is thin; null for failed answers."""
    leaning = p_of(probs, "core") + p_of(probs, "adjacent") + F.when(is_thin(text), p_of(probs, "insufficient")).otherwise(0.0)
    return F.when(status == "ok", F.coalesce(leaning, F.lit(0.0)))


def rescued(answers: DataFrame, most: int = RESCUE_MOST) -> DataFrame:
    """(company_key, rescue_score, rescue_rank): gate misses that are read again, at most ``most``.

    ``answers`` has company_key, security_id, status, label, probs, text, market_cap_usd, has_document, was_rescued. Rows with a stored
    document go first, then those rescued before, then by score, size and id. Ranks come from a sort with limit, so no window holds all rows.
    """
    score = rescue_score(F.col("status"), F.col("probs"), F.col("text"))
    missed = answers.where(~passes_gate(F.col("status"), F.col("label"), F.col("probs"))).withColumn("rescue_score", score).where(F.col("rescue_score") >= RESCUE_LEAST)
    order = [F.desc("has_document"), F.desc("was_rescued"), F.desc("rescue_score"), F.desc(F.coalesce("market_cap_usd", F.lit(0.0))), F.col("security_id")]
    top = missed.orderBy(*order).limit(most)
    # at most ``most`` rows
    return top.withColumn("rescue_rank", F.row_number().over(Window.orderBy(*order))).select("company_key", "rescue_score", "rescue_rank")


def _size_bonus(cap: Column) -> Column:
    return F.when(cap > 0, SIZE_WEIGHT * F.log10(cap)).otherwise(0.0)


def score_by_label(label: Column, p_core: Column, cap: Column, evidence: Column) -> Column:
    """The label's weight (half for a positive one read from a profile), the first answer's core probability, and a little for size."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv])[label], F.lit(0.0))
    halved = F.coalesce((evidence == "profile") & label.isin("explicit", "partial"), F.lit(False))
    return F.when(halved, weight * PROFILE_FACTOR).otherwise(weight) + CORE_WEIGHT * F.coalesce(p_core, F.lit(0.0)) + _size_bonus(cap)


def score_by_expectation(p_explicit: Column, p_partial: Column, p_core: Column, cap: Column, evidence: Column) -> Column:
    """As ``score_by_label`` with the label's weight in expectation; a profile supports partial at most and counts half."""
    explicit, partial = F.coalesce(p_explicit, F.lit(0.0)), F.coalesce(p_partial, F.lit(0.0))
    full = LABEL_WEIGHTS["explicit"] * explicit + LABEL_WEIGHTS["partial"] * partial
    profile = LABEL_WEIGHTS["partial"] * (explicit + partial) * PROFILE_FACTOR
    return F.when(F.coalesce(evidence == "profile", F.lit(False)), profile).otherwise(full) + CORE_WEIGHT * F.coalesce(p_core, F.lit(0.0)) + _size_bonus(cap)


def constraint_state(label: Column, answer: Column) -> Column:
    """State of an explicit row's stated constraints: met, missing, unclear, or unchecked without an answer; null for other rows."""
    return F.when(label == "explicit", F.when(answer.isNull(), "unchecked").when(answer == "met", "met").when(answer == "product_only", "missing").otherwise("unclear"))


def is_demoted(state: Column) -> Column:
    return F.coalesce(state.isin("missing", "unclear"), F.lit(False))


def constrained_probabilities(p_explicit: Column, p_partial: Column, state: Column) -> tuple[Column, Column]:
    """(p_explicit, p_partial) with the explicit mass of a demoted row moved to partial."""
    moves = is_demoted(state) & p_explicit.isNotNull()
    return F.when(moves, 0.0).otherwise(p_explicit), F.when(moves, F.coalesce(p_partial, F.lit(0.0)) + p_explicit).otherwise(p_partial)


def counter_evidence(facts: dict[str, tuple[Column, Column]], has_target: Column) -> Column:
    """Array of 'family:value' for answers that speak against a row with enough probability; ``facts`` has (label, p) by family."""
    hits = []
    for family, (label, p) in facts.items():
        against = label.isin(*AGAINST[family]) & (p >= DEMOTE_LEAST)
        hits.append(F.when(against & has_target if family == "target" else against, F.concat(F.lit(f"{family}:"), label)))
    return F.array_compact(F.array(*hits))


def judged_tier(label: Column, facts: dict[str, tuple[Column, Column]], has_target: Column) -> Column:
    """A where all families speak for an explicit row, C where one speaks against it, else B; without answers B."""
    favour = label == "explicit"
    for family, (answer, _) in facts.items():
        fits = F.coalesce(answer.isin(*IN_FAVOUR[family]), F.lit(False))
        favour &= (~has_target | fits) if family == "target" else fits
    return F.when(F.size(counter_evidence(facts, has_target)) > 0, "C").when(F.coalesce(favour, F.lit(False)), "A").otherwise("B")


def tier_rank(tier: Column, verdict: Column, agent_applied_yes: Column) -> Column:
    """The tier's place in the order: a person's verdict counts as A or B, an applied yes lifts C to B, no tier is 0."""
    return (
        F.when(verdict == "explicit", 0).when(verdict == "partial", 1).when(tier.isNull(), 0).when(tier == "A", 0)
        .when((tier == "C") & ~F.coalesce(agent_applied_yes, F.lit(False)), 2).otherwise(1)
    )


def evidence_tier(first_label: Column, label: Column, capped: Column) -> Column:
    """explicit or partial with core or adjacent, profile_capped for an explicit reading of a profile alone, else other."""
    kind = F.when(first_label == "core", "core").otherwise("adjacent")
    return F.when(label == "explicit", F.concat(F.lit("explicit_"), kind)).when(F.coalesce(capped, F.lit(False)), "profile_capped").when(label == "partial", F.concat(F.lit("partial_"), kind)).otherwise("other")


def most_restricted(tiers: Column) -> Column:
    """The most restricted licence tier of an array; unknown tiers are above all, nulls are skipped, null for none."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(LICENCE_TIERS) for x in (t, i)])
    ranked = F.transform(F.array_compact(tiers), lambda t: F.struct(F.coalesce(order[t], F.lit(len(LICENCE_TIERS))).alias("r"), t.alias("t")))
    return F.array_max(ranked)["t"]


def known_labels(probs: Column, labels: tuple[str, ...]) -> Column:
    """An answer without labels that the question does not have."""
    return F.map_filter(probs, lambda k, v: k.isin(*labels) & v.isNotNull())


def top_outside(probs: Column, neutral: tuple[str, ...]) -> Column:
    """The greatest probability of a label that is not neutral, 0 where there is none."""
    return F.coalesce(F.array_max(F.map_values(F.map_filter(probs, lambda k, v: ~k.isin(*neutral)))), F.lit(0.0))


def in_band(probs: Column, neutral: tuple[str, ...]) -> Column:
    """Whether an answer is close enough to be read again."""
    return top_outside(probs, neutral).between(*BAND)


def apply_scope(rows: DataFrame, labels: DataFrame, rules: DataFrame, pinned: DataFrame) -> DataFrame:
    """``rows`` with scope_effect (remove, demote or null), scope_rule and scope_unchecked.

    ``rows`` have company_key, evidence_sha; ``labels`` company_key, family, value, p, evidence_sha; ``rules`` rule_no, family, value, effect:
    a given, short list. A rule hits a row whose label of its family is its value, read with enough probability on the very evidence
    that the row has now. The first rule that hits decides. Keys in ``pinned`` (company_key) are left alone. Rows without a label of a
    rule's family are unchecked.
    """
    hits = labels.join(rules, ["family", "value"]).where(F.col("p") >= ENFORCE_LEAST)
    hits = hits.join(rows.select("company_key", "evidence_sha"), ["company_key", "evidence_sha"])
    first = hits.groupBy("company_key").agg(F.min_by(F.struct("effect", "rule_no"), "rule_no").alias("hit"))
    families = rules.agg(F.count_distinct("family").alias("asked"))
    seen = labels.join(rules.select("family").distinct(), "family", "left_semi").groupBy("company_key").agg(F.count_distinct("family").alias("seen"))
    marked = rows.join(first, "company_key", "left").join(seen, "company_key", "left").join(pinned.select("company_key").distinct().withColumn("__pinned", F.lit(True)), "company_key", "left")
    marked = marked.crossJoin(families)  # one row
    free = F.col("__pinned").isNull()
    return marked.select(
        *rows.columns, F.when(free, F.col("hit.effect")).alias("scope_effect"), F.when(free, F.col("hit.rule_no")).alias("scope_rule"), (free & (F.coalesce("seen", F.lit(0)) < F.col("asked"))).alias("scope_unchecked")
    )


def final_order(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` that stay, with rank (from 1), backfill and below_cut.

    ``rows`` have company_key, security_id, tier_rank, score, market_cap_usd, scope_effect, verdict (explicit, partial, no or null). Removed rows
    and those with a person's no go; a person's yes brings a removed row back. Demoted rows stand after all others, then by tier, score,
    size and id. backfill: among the first ``most`` now, not before, and by nobody's yes. Rows beyond ``most`` stay only with a yes (below_cut).
    """
    from tallyweir.operators.ranking import ranked

    yes = F.coalesce(F.col("verdict").isin("explicit", "partial"), F.lit(False))
    order = [F.col("tier_rank"), F.desc("score"), F.desc(F.coalesce("market_cap_usd", F.lit(0.0))), F.col("security_id")]
    before = ranked(rows, order, name="rank_before")
    stays = yes | ((F.coalesce("scope_effect", F.lit("")) != "remove") & (F.coalesce("verdict", F.lit("")) != "no"))
    demoted = F.coalesce((F.col("scope_effect") == "demote") & ~yes, F.lit(False)).cast("int")
    now = ranked(before.where(stays).withColumn("__demoted", demoted), [F.col("__demoted"), *order], name="rank")
    flagged = now.withColumn("backfill", (F.col("rank") <= most) & (F.col("rank_before") > most) & ~yes).withColumn("below_cut", (F.col("rank") > most) & yes)
    return flagged.where((F.col("rank") <= most) | F.col("below_cut")).drop("rank_before", "__demoted")


def splits(rows: DataFrame, labels: DataFrame, keep: dict[str, str]) -> DataFrame:
    """(family, value, n_value, n_keep): on which answers the listed rows really part.

    ``rows`` (company_key) is the list that is shown; ``keep`` names each family's value that stays. A value is a split if it and the kept
    value have their least number and share of rows, each with enough probability. At most ``SPLITS_MOST``, larger ones first, none that
    overlaps an earlier one by more than half.
    """
    shown = rows.select("company_key").distinct()
    sure = labels.where(F.col("p") >= ASK_LEAST).join(shown, "company_key", "left_semi")
    kept = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])[F.col("family")]
    counts = sure.groupBy("family", "value").agg(F.count_distinct("company_key").alias("n"))
    base = counts.where(F.col("value") == kept).select("family", F.col("n").alias("n_keep"))
    total = shown.agg(F.count("*").alias("total"))
    met = counts.where(F.col("value") != kept).join(base, "family").crossJoin(total)  # one row
    found = met.where((F.col("n") >= F.greatest(F.lit(SPLIT_LEAST), F.ceil(SPLIT_SHARE * F.col("total")))) & (F.col("n_keep") >= F.greatest(F.lit(SPLIT_LEAST), F.ceil(KEEP_SHARE * F.col("total")))))
    # how far each side overlaps another: one row a pair of values, of which a question has a handful
    side = sure.join(found.select("family", "value", "n"), ["family", "value"]).select("company_key", "family", "value", "n").distinct()
    a, b = side.alias("a"), side.alias("b")
    shared = a.join(b, F.col("a.company_key") == F.col("b.company_key")).groupBy("a.family", "a.value", F.col("b.family").alias("f2"), F.col("b.value").alias("v2")).agg(F.count("*").alias("both")).collect()
    listed = sorted(found.select("family", "value", "n", "n_keep").collect(), key=lambda r: (-r["n"], list(keep).index(r["family"]), r["value"]))
    overlap = {(r["family"], r["value"], r["f2"], r["v2"]): r["both"] for r in shared}
    chosen = []
    for r in listed:
        if len(chosen) < SPLITS_MOST and not any(overlap.get((r["family"], r["value"], c["family"], c["value"]), 0) > OVERLAP_MOST * r["n"] for c in chosen):
            chosen.append(r)
    return rows.sparkSession.createDataFrame([tuple(r) for r in chosen], "family string, value string, n_value long, n_keep long")
