"""Variant spellings of names typed by people (problem 7): merge-and-rematch resolution.

A text becomes one or more forms (core by sound, business, initial). Equal forms are one node. Then, round by round until
nothing merges:

* Every cluster is a profile with all core spellings and initials of its members.
* Spellings that stood side by side in one text merge without further proof.
* Spellings block on what one edit leaves intact: the core itself and every core with one letter left out, which finds all
  cores within one edit (insertion, deletion, substitution, swap) of the same business.
* A profile whose spellings are rare beside another's (single, or few for its size) joins the one best stronger profile; two
  profiles that are both too frequent to be slips of each other stay apart, at any size of the corpus.
* Names without business join the only company with their core; names with a first initial join the only company whose first
  word begins with it.
* A merged profile enters blocking again with what its spellings make together: a core of one with the business of another, the
  initials of one with the rest of another's name.

Hot blocks: keys are pre-aggregated to distinct spellings, so a form held by a third of all rows is one row here; members
join back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.names import Lexicon, learn_lexicon
from tallyweir.session import checkpointed, release_finished, ship_package

SLIP_SHARE = 0.02  # of the occurrences of a spelling: one and the same slip is made no more often
NONE = "~"
FEW = 50_000  # counted rows of keys, some hundred bytes each, that may be sent to all executors


def _read(lexicon: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(*lexicon)
        for pdf in batches:
            rows = []
            for key, text, market in zip(pdf["id"], pdf["text"], pdf["market"]):
                for r in lex.readings(text):
                    first = r["words"][0] if r["words"] else ""
                    rest = "".join(r["words"][1:])
                    rows.append((key, market, r["core"], r["business"] or NONE, bool(r["initial"]), first if len(r["words"]) > 1 else "", rest, r["raw"]))
            yield pd.DataFrame(rows, columns=["id", "market", "core", "business", "initial", "first", "rest", "raw"])

    return run


def read_names(rows: DataFrame, row_id: str, text: str, market: str | None, lexicon: Lexicon) -> DataFrame:
    """(id, market, core, business, initial, first, rest, raw): the readings of each row's name."""
    ship_package(rows.sparkSession)
    id_type = rows.schema[row_id].dataType.simpleString()
    slim = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(row_id).alias("id"), F.col(text).alias("text"), (F.nullif(F.trim(F.col(market)), F.lit("")) if market else F.lit(None).cast("string")).alias("market")
    )
    return slim.mapInPandas(
        _read((lexicon.phrases, lexicon.endings, lexicon.sounds)),
        f"id {id_type}, market string, core string, business string, initial boolean, first string, rest string, raw string",
    )


def deletions(core: Column) -> Column:
    """The core and every core with one letter left out."""
    each = F.transform(F.sequence(F.lit(1), F.length(core)), lambda i: F.concat(core.substr(F.lit(1), i - 1), core.substr(i + 1, F.length(core))))
    return F.array_distinct(F.concat(F.array(core), each))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two words that share a deletion are one edit apart, a swap of neighbours counting as one."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swapped


def _meet(x: DataFrame, y: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the names: sorted on both sides, never by way of the driver.

    Spark broadcasts what is small compressed, by the size of files and shuffles; spellings and their keys, alike as they are, take ten to
    a hundred times as much in memory, more than the driver has.
    """
    return x.join(y.hint("merge"), on, how)


def resolve(rows: DataFrame, row_id: str = "alias_id", text: str = "text", market: str | None = "market", lexicon: Lexicon | None = None) -> DataFrame:
    """(row_id, cluster): rows that name the same company share a cluster.

    Null, empty and placeholder texts are left out. A text that spells two names (two scripts side by side) merges them. Ties
    between possible companies go to the one whose market agrees; where several remain, nothing is merged.
    """
    lexicon = lexicon or learn_lexicon(rows.select(F.col(text).alias("text")))
    release_finished(rows.sparkSession)
    read = checkpointed(read_names(rows, row_id, text, market, lexicon))
    # forms: distinct spellings with their support; a name without business stands for its market only
    sure = (F.col("business") != NONE) & ~F.col("initial")
    local = F.when(sure, F.lit("")).otherwise(F.coalesce("market", F.lit("")))
    read = read.withColumn("node", F.concat_ws("|", "core", "business", F.col("initial").cast("string"), local))
    # spellings given side by side: each distinct pair of forms
    beside = read.groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where(F.col("x") != F.col("y")).select("x", "y").distinct()
    beside = beside.select("x", "y", F.lit(-1).alias("kind")).unionByName(beside.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(-1).alias("kind")))
    forms = read.groupBy("node").agg(
        F.first("core").alias("core"), F.first("business").alias("business"), F.first("initial").alias("initial"),
        F.min(F.nullif("first", F.lit(""))).alias("first"), F.min(F.nullif("rest", F.lit(""))).alias("rest"), F.min(F.nullif("raw", F.lit(""))).alias("raw"),
        F.count_distinct("id").alias("n"), F.collect_set("market").alias("markets"),
    )
    forms = checkpointed(forms)  # small beside the rows: one per distinct spelling
    keyed = checkpointed(_keyed(forms))  # read in every round
    release_finished(rows.sparkSession)
    pairs = checkpointed(_pairs(keyed, keyed).unionByName(beside))
    # One edit until nothing merges; then the merged profiles block again with what their members' spellings make together; then two
    # edits. Whatever merges sends all back to the first step.
    steps, far_pairs = ("near", "again", "far"), None
    at = 0
    members = checkpointed(_members(forms, forms.select("node", F.col("node").alias("cluster"))))
    while at < len(steps):
        release_finished(rows.sparkSession)
        if steps[at] == "near":
            met = pairs
        elif steps[at] == "again":
            met = _profile_pairs(forms, keyed, members)
        else:
            met = far_pairs = far_pairs or checkpointed(_far_pairs(forms))
        found = checkpointed(_proposals(met, members, steps[at] == "far"))
        if found.isEmpty():
            at += 1
            continue
        at = 0
        release_finished(rows.sparkSession)
        members = checkpointed(_members(forms, _follow(members.select("node", "cluster"), found)))
    return _meet(read.select("id", "node"), members.select("node", "cluster"), "node").select(F.col("id").alias(row_id), "cluster").distinct()


def deletions2(core: Column) -> Column:
    """The core and every core with one or two letters left out."""
    return F.array_distinct(F.flatten(F.transform(deletions(core), lambda x: deletions(x))))


def may_be_slip(n: Column, right: Column) -> Column:
    """Whether a spelling is rare enough beside another to be a slip of it: once, or as often as one slip is made of so many."""
    return n <= 1 + SLIP_SHARE * right


def _far_pairs(forms: DataFrame) -> DataFrame:
    """(x, y, kind): spellings of eight letters and more within two edits (deletions on either side, so a swap may count as
    one) of another spelling of their business, beside which they are rare."""
    full = forms.where((F.col("business") != NONE) & ~F.col("initial") & (F.length("core") >= 8))
    keyed = lambda spelt: spelt.select("node", "core", "business", "n", F.explode(deletions2(F.col("core"))).alias("key"))
    # what is no slip beside the most frequent spelling of its business is one beside none; the lexicon bounds the phrases of business
    most = full.groupBy("business").agg(F.max("n").alias("most"))
    x, y = keyed(full.join(F.broadcast(most), "business").where(may_be_slip(F.col("n"), F.col("most")))).alias("x"), keyed(full).alias("y")
    near = _meet(x, y, ["business", "key"]).where((F.col("x.node") != F.col("y.node")) & may_be_slip(F.col("x.n"), F.col("y.n")) & (F.levenshtein(F.col("x.core"), F.col("y.core")) <= 3))
    return near.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"), F.lit(3).alias("kind")).distinct()


def _profile_pairs(forms: DataFrame, keyed: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y, kind) by keys that no single spelling has but a profile's spellings make together.

    * A core of one member with the business of another: both could stand in one name.
    * A first initial and the rest of a name: the profile has a member of that rest and one whose first word begins so.
    """
    spelt = _meet(members.select("node", "cluster"), forms.where(~F.col("initial")), "node").select("node", "cluster", "core", "business", "first", "rest", "raw", "n", "initial", "markets")
    # profiles of one spelling make nothing new
    several = members.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("cluster")
    spelt = _meet(spelt, several, "cluster")
    trades = spelt.where(F.col("business") != NONE).select("cluster", "business").distinct()
    # the name stands for the member that has its core; phrases of business are a bounded table
    made = _meet(spelt.select("cluster", "node", "core", "raw", "first", "rest", F.col("business").alias("own")), trades, "cluster").where(F.col("business") != F.col("own"))
    known = forms.where((F.col("business") != NONE) & ~F.col("initial")).select("core", "business")
    made = _meet(made, known, ["core", "business"], "left_anti").groupBy("core", "business", "cluster").agg(*[F.min(c).alias(c) for c in ("node", "raw", "first", "rest")])
    made = made.select("node", "core", "business", F.lit(False).alias("initial"), "first", "rest", "raw")
    made = checkpointed(_keyed(made))
    asks = forms.where(F.col("initial") & F.col("rest").isNotNull()).select(F.col("node").alias("x"), F.col("first").alias("letter"), "rest", F.col("business").alias("trade"))
    offers = spelt.where((F.col("business") != NONE) & F.col("rest").isNotNull()).select(F.col("node").alias("y"), "cluster", "rest", "business")
    letters = spelt.where((F.col("business") != NONE) & F.col("first").isNotNull()).select("cluster", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("first"), F.lit(3))), lambda k: F.substring("first", 1, 3).substr(F.lit(1), k))).alias("letter")).distinct()
    met = _meet(_meet(asks, offers, "rest").where((F.col("trade") == F.col("business")) | (F.col("trade") == NONE)), letters, ["cluster", "letter"])
    met = met.select("x", "y", F.lit(0).alias("kind")).distinct()
    rows = made.count()
    # the keys of all forms are many times as many: where those made are few, they go to them
    x, y = ("x", "y") if rows <= FEW else ("", "")
    return met.unionByName(_pairs(keyed, made, y)).unionByName(_pairs(made, keyed, x)).distinct() if rows else met


def _clash(a: Column, b: Column) -> Column:
    """Whether markets are known on both sides and don't meet."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _keys() -> Column:
    """The blocking keys of a form, as structs of key, rule and side (asks, is asked or both)."""
    core, business, raw, rest = (F.col(c) for c in ("core", "business", "raw", "rest"))
    named = (business != NONE) & ~F.col("initial")
    nothing = F.array().cast("array<struct<rule:string,side:string,key:string>>")

    def keyed(when: Column, rule: str, side: str, keys: Column) -> Column:
        made = F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), F.lit(side).alias("side"), F.concat_ws("|", F.lit(rule), k).alias("key")))
        return F.when(when, made).otherwise(nothing)

    in_business = lambda keys: F.transform(keys, lambda k: F.concat_ws("|", business, k))
    stem = F.regexp_replace(core, "(?:sy|ie|y|[aeiou])$", "")
    tender = F.regexp_extract(core, "(?:sy|ie|y)$", 0) != ""
    starts = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: core.substr(F.lit(1), F.length(core) - k))
    return F.concat(
        # one edit within a business; very short cores are too easily one edit apart
        keyed(named & (F.length(core) >= 5), "edit", "both", in_business(deletions(core))),
        # one character of the native spelling: sounds hide which of two swapped or mistaken characters it was
        keyed(named & (F.length(raw) >= 3), "sign", "both", in_business(deletions(raw))),
        # cores cut short
        keyed(named & (F.length(core) >= 6), "clip", "asks", in_business(F.array(core))),
        keyed(named & (F.length(core) >= 9), "clip", "asked", in_business(starts)),
        # endings of endearment: the core up to its last vowels
        keyed(named & (F.length(core) >= 6) & tender, "tender", "both", in_business(F.array(stem))),
        keyed(named & (F.length(core) >= 6) & ~tender, "tender", "asked", in_business(F.array(stem))),
        # names without business, by the core itself and by one edit
        keyed((business == NONE) & ~F.col("initial"), "bare", "asks", F.array(core)),
        keyed(named, "bare", "asked", F.array(core)),
        keyed((business == NONE) & ~F.col("initial") & (F.length(core) >= 6), "loose", "asks", deletions(core)),
        keyed(named & (F.length(core) >= 6), "loose", "asked", deletions(core)),
        # first initials
        keyed(F.col("initial") & rest.isNotNull(), "initial", "asks", F.array(rest)),
        keyed(named & rest.isNotNull(), "initial", "asked", F.array(rest)),
    )


def _keyed(forms: DataFrame) -> DataFrame:
    """The blocking keys of forms, a row each."""
    return forms.select("node", "core", "raw", "business", "first", F.explode(_keys()).alias("k")).select("*", "k.rule", "k.side", "k.key").drop("k")


def _pairs(asking: DataFrame, asked: DataFrame, few: str = "") -> DataFrame:
    """(x, y, kind): which form of ``asking`` (x) could stand for which of ``asked`` (y), by any rule. All rules share one join on their keys.
    The side that is named ``few`` is sent to all executors.

    kind: 0 the same core or an initial, 1 one slip, 2 a shortened or bare name with a slip.
    """
    x, y = asking.where(F.col("side") != "asked").alias("x"), asked.where(F.col("side") != "asks").alias("y")
    on = F.col("x.key") == F.col("y.key")
    met = (F.broadcast(x).join(y, on) if few == "x" else x.join(F.broadcast(y), on) if few == "y" else _meet(x, y, on)).where(F.col("x.node") != F.col("y.node"))
    rule, cores = F.col("x.rule"), (F.col("x.core"), F.col("y.core"))
    holds = (
        F.when(rule.isin("edit", "loose"), within_one_edit(*cores))
        .when(rule == "sign", within_one_edit(F.col("x.raw"), F.col("y.raw")))
        .when(rule == "initial", F.startswith(F.col("y.first"), F.col("x.first")) & ((F.col("x.business") == F.col("y.business")) | (F.col("x.business") == NONE)))
        .otherwise(True)
    )
    kind = F.when(rule.isin("bare", "initial"), 0).when(rule.isin("loose", "clip"), 2).otherwise(1)
    return met.where(holds).groupBy(F.col("x.node").alias("x"), F.col("y.node").alias("y")).agg(F.min(kind).alias("kind"))


def _proposals(pairs: DataFrame, members: DataFrame, far: bool) -> DataFrame:
    """(a, b): one further merge for each profile that has a single best partner among its members' pairs (kind -1: side by side)."""
    side = lambda s: members.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cluster", "n", "top", "size", "markets")])
    met = _meet(_meet(pairs, side("x"), "x"), side("y"), "y").where(F.col("cluster_x") != F.col("cluster_y"))
    same, clash = F.coalesce(F.arrays_overlap("markets_x", "markets_y"), F.lit(False)), _clash(F.col("markets_x"), F.col("markets_y"))
    if far:
        # a lone partner needs the same market; of two lone spellings the later one moves
        firm = (F.col("size_y") > F.col("size_x")) | (same & (F.col("size_y") == F.col("size_x")) & (F.col("cluster_x") > F.col("cluster_y")))
        met = met.where(may_be_slip(F.col("size_x"), F.col("size_y")) & firm & ~clash)
        chosen = met.groupBy(F.col("cluster_x").alias("a")).agg(F.count_distinct("cluster_y").alias("k"), F.min("cluster_y").alias("b"))
        return chosen.where(F.col("k") == 1).select("a", "b")
    # the weaker joins the stronger; one too frequent to be a slip stays apart; markets that are both known must meet
    weaker = (F.col("top_x") < F.col("top_y")) | ((F.col("top_x") == F.col("top_y")) & ((F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("cluster_x") > F.col("cluster_y")))))
    met = met.where(weaker & ((F.col("kind") == -1) | (may_be_slip(F.col("top_x"), F.col("top_y")) & ~clash)))
    rank = F.struct((-F.col("kind")).alias("kind"), same.cast("int").alias("same"))
    offered = met.groupBy(F.col("cluster_x").alias("a"), rank.alias("rank"), F.col("cluster_y").alias("b")).agg(F.max("n_y").alias("nb"), F.max("size_y").alias("size_b"))
    ranked = offered.groupBy("a", "rank").agg(F.count("*").alias("k"), F.max_by("b", F.struct("nb", "size_b", "b")).alias("b"), F.max("nb").alias("nb"), F.min("nb").alias("least"))
    best = ranked.groupBy("a").agg(F.max_by(F.struct("k", "b", "nb", "least", "rank"), "rank").alias("m")).select("a", "m.*")
    # several equal partners: typing slips go to a clearly stronger one, bare names to none
    return best.where((F.col("k") == 1) | (F.col("rank.kind") == 1) | ((F.col("rank.kind") == -1) & (F.col("nb") > 2 * F.col("least")))).select("a", "b")


def _members(forms: DataFrame, clusters: DataFrame) -> DataFrame:
    """Forms with their profile: support of its best spelling, its size and markets."""
    f = _meet(forms, clusters, "node")
    profile = f.groupBy("cluster").agg(
        F.coalesce(F.max(F.when((F.col("business") != NONE) & ~F.col("initial"), F.col("n"))), F.lit(0)).alias("top"),
        F.sum("n").alias("size"),
    )
    # each market once: a set as long as the list of markets, whatever the cluster's size
    markets = f.select("cluster", F.explode("markets").alias("m")).groupBy("cluster").agg(F.collect_set("m").alias("markets"))
    profile = _meet(profile, markets, "cluster", "left").withColumn("markets", F.coalesce("markets", F.array().cast("array<string>")))
    return _meet(f.select("node", "cluster", "n"), profile, "cluster")


def _follow(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters after merges; partners that themselves moved are followed two steps, the next round finds what is left."""
    step = found.select(F.col("a").alias("at"), F.col("b").alias("to"))
    for _ in range(2):
        further = step.select(F.col("at").alias("to"), F.col("to").alias("next"))
        step = _meet(step, further, "to", "left").select("at", F.coalesce("next", "to").alias("to"))
    return _meet(clusters, step, F.col("cluster") == F.col("at"), "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def same_pairs(resolved: DataFrame, row_id: str = "alias_id") -> DataFrame:
    """(a, b), smaller first: all pairs of rows that share a cluster, each once, as the required result has them. AQE splits a hot cluster's
    join. For other uses ``resolve`` has one row per row and cluster."""
    x, y = resolved.alias("x"), resolved.alias("y")
    pairs = _meet(x, y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col(f"x.{row_id}") < F.col(f"y.{row_id}")))
    return pairs.select(F.col(f"x.{row_id}").alias(f"{row_id}_a"), F.col(f"y.{row_id}").alias(f"{row_id}_b")).distinct()
