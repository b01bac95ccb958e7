"""Queries of screening and of listings. Answers of a classifier are drawn from bytes of a key's MD5, the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions import evidence, fields
from tallyweir.functions import text as tx
from tallyweir.operators import relational as rel
from tallyweir.operators import screening as sc
from tallyweir.session import checkpointed, table
from tallyweir.sources import listings as ls
from tallyweir.sources import schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PRODUCTS = ("own", "component", "assembly_only", "adjacent", "none")
ROLES = ("supplier", "buyer_user", "upstream", "channel", "minority_holder", "other_link", "unclear")
TARGETS = ("named", "one_of_several", "other_only", "not_stated")
CHECKS = ("met", "product_only", "unclear")
FACETS = {"role": ("maker", "reseller"), "scope": ("focused", "general_only"), "geo": ("inside", "outside")}
RULES = ((1, "role", "reseller", "remove"), (2, "scope", "general_only", "demote"))


def _byte(key: Column, k: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1 + 2 * k, 2), 16, 10).cast("int")


def _b(key: str, k: int) -> str:
    return f"CAST('0x' || substring(md5({key}), {1 + 2 * k}, 2) AS INTEGER)"


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _p(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """One row a company: a first and a second answer, facts, text and size."""
    lines = rel.first_per_key(table(spark, d, "securities").where(F.col("company_key").isNotNull()).select("company_key", "security_id"), ["company_key"], [F.col("security_id")])
    texts = table(spark, d, "documents").where(F.col("security_id").isNotNull()).groupBy("security_id").agg(F.max_by("text", "doc_id").alias("text"))
    caps = table(spark, d, "market_daily").groupBy("security_id").agg(F.max("market_cap_usd").alias("market_cap_usd"))
    k = F.col("company_key")
    a, b, c, e = (_byte(k, i) for i in range(4))
    total = a + b + c + e + 1
    first = F.create_map(F.lit("core"), a / total, F.lit("adjacent"), b / total, F.lit("insufficient"), c / total, F.lit("unrelated"), e / total)
    x, y, z = (_byte(k, i) for i in (4, 5, 6))
    second = F.create_map(F.lit("explicit"), x / (x + y + z + 1), F.lit("partial"), y / (x + y + z + 1), F.lit("insufficient"), z / (x + y + z + 1))
    label = F.when((a >= b) & (a >= c) & (a >= e), "core").when((b >= c) & (b >= e), "adjacent").when(c >= e, "insufficient").otherwise("unrelated")
    label2 = F.when((x >= y) & (x >= z), "explicit").when(y >= z, "partial").otherwise("insufficient")
    return lines.join(texts, "security_id", "left").join(caps, "security_id", "left").select(
        "company_key", "security_id", "text", "market_cap_usd", first.alias("probs"), label.alias("label"), F.when(_byte(k, 7) >= 20, "ok").otherwise("failed").alias("status"),
        second.alias("probs2"), label2.alias("label2"), F.when(_byte(k, 8) % 2 == 0, "profile").otherwise("annual_report").alias("evidence"),
        _pick(PRODUCTS, _byte(k, 9)).alias("product"), _pick(ROLES, _byte(k, 10)).alias("role"), _pick(TARGETS, _byte(k, 11)).alias("target"), (_byte(k, 12) / 255).alias("p_fact"),
        F.when(_byte(k, 13) >= 40, _pick(CHECKS, _byte(k, 13))).alias("check"), (_byte(k, 14) % 2 == 0).alias("has_document"), (_byte(k, 15) % 16 == 0).alias("was_rescued"),
    )


_ANSWERS = f"""
s AS (SELECT company_key, min(security_id) AS security_id FROM securities WHERE company_key IS NOT NULL GROUP BY 1),
x AS (SELECT s.*, t.text, m.cap AS market_cap_usd, {", ".join(f"{_b('company_key', i)} AS b{i}" for i in range(16))} FROM s LEFT JOIN (SELECT security_id, arg_max_null(text, doc_id) AS text FROM documents WHERE security_id IS NOT NULL GROUP BY 1) t USING (security_id)
 LEFT JOIN (SELECT security_id, max(market_cap_usd) AS cap FROM market_daily GROUP BY 1) m USING (security_id)),
ans AS (SELECT *, b0 / (b0 + b1 + b2 + b3 + 1) AS core, b1 / (b0 + b1 + b2 + b3 + 1) AS adjacent, b2 / (b0 + b1 + b2 + b3 + 1) AS insufficient,
 CASE WHEN b0 >= greatest(b1, b2, b3) THEN 'core' WHEN b1 >= greatest(b2, b3) THEN 'adjacent' WHEN b2 >= b3 THEN 'insufficient' ELSE 'unrelated' END AS label, CASE WHEN b7 >= 20 THEN 'ok' ELSE 'failed' END AS status,
 b4 / (b4 + b5 + b6 + 1) AS explicit, b5 / (b4 + b5 + b6 + 1) AS partial, CASE WHEN b4 >= greatest(b5, b6) THEN 'explicit' WHEN b5 >= b6 THEN 'partial' ELSE 'insufficient' END AS label2,
 CASE WHEN b8 % 2 = 0 THEN 'profile' ELSE 'annual_report' END AS evidence, {_p(PRODUCTS, 'b9')} AS product, {_p(ROLES, 'b10')} AS role, {_p(TARGETS, 'b11')} AS target, b12 / 255 AS p_fact,
 CASE WHEN b13 >= 40 THEN {_p(CHECKS, 'b13')} END AS checked, b14 % 2 = 0 AS has_document, b15 % 16 = 0 AS was_rescued FROM x),
gate AS (SELECT *, status = 'ok' AND ((label = 'core') OR (label = 'adjacent' AND core + adjacent >= 0.6)) AS passes FROM ans)"""
_BARE = r"coalesce(regexp_replace(text, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'), '')"
_THIN = rf"""(SELECT company_key AS ck, length(t) < (CASE WHEN len(regexp_extract_all(t, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]')) * 3 > length(t) THEN 150 ELSE 400 END) OR regexp_matches(t, '(…|\.\.\.)$') OR NOT regexp_matches(t, '[.!?。！？)）"”''」』\]]$') AS thin FROM (SELECT company_key, {_BARE} AS t FROM ans))"""


@query(f"WITH {_ANSWERS} SELECT company_key, passes FROM gate")
def l1_gate(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("company_key", sc.passes_gate(F.col("status"), F.col("label"), F.col("probs")).alias("passes"))


@query(f"WITH {_ANSWERS} SELECT ck AS company_key, thin FROM {_THIN}")
def profile_thin(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("company_key", sc.is_thin(F.col("text")).alias("thin"))


_RESCUE = f"r AS (SELECT g.*, core + adjacent + CASE WHEN thin THEN insufficient ELSE 0 END AS lean FROM gate g JOIN {_THIN} ON ck = company_key WHERE NOT passes AND status = 'ok')"


@query(f"""
WITH {_ANSWERS}, {_RESCUE} SELECT company_key, round(lean, 9) AS rescue_score, CAST(row_number() OVER (ORDER BY has_document DESC, was_rescued DESC, lean DESC, coalesce(market_cap_usd, 0) DESC, security_id) AS INTEGER) AS rescue_rank
FROM r WHERE lean >= 0.30 ORDER BY rescue_rank LIMIT 20
""")
def l1_rescue(spark: SparkSession, d: str) -> DataFrame:
    """The twenty misses that are read again; twenty is the feature."""
    return sc.rescued(answers(spark, d)).withColumn("rescue_score", F.round("rescue_score", 9))


@query(f"""
WITH {_ANSWERS} SELECT company_key, round(CASE label2 WHEN 'explicit' THEN 3.0 WHEN 'partial' THEN 1.5 ELSE 0.5 END * CASE WHEN evidence = 'profile' AND label2 IN ('explicit', 'partial') THEN 0.5 ELSE 1 END + 2 * core + CASE WHEN market_cap_usd > 0 THEN 0.01 * log10(market_cap_usd) ELSE 0 END, 6) AS score FROM ans
""")
def score_label(spark: SparkSession, d: str) -> DataFrame:
    score = sc.score_by_label(F.col("label2"), sc.p_of(F.col("probs"), "core"), F.col("market_cap_usd"), F.col("evidence"))
    return answers(spark, d).select("company_key", F.round(score, 6).alias("score"))


@query(f"""
WITH {_ANSWERS}, c AS (SELECT *, CASE WHEN label2 = 'explicit' THEN coalesce(CASE checked WHEN 'met' THEN 'met' WHEN 'product_only' THEN 'missing' WHEN 'unclear' THEN 'unclear' END, 'unchecked') END AS state FROM ans),
e AS (SELECT *, CASE WHEN state IN ('missing', 'unclear') THEN 0 ELSE explicit END AS pe, CASE WHEN state IN ('missing', 'unclear') THEN partial + explicit ELSE partial END AS pp FROM c)
SELECT company_key, state, round(CASE WHEN evidence = 'profile' THEN 0.5 * 1.5 * (pe + pp) ELSE 3 * pe + 1.5 * pp END + 2 * core + CASE WHEN market_cap_usd > 0 THEN 0.01 * log10(market_cap_usd) ELSE 0 END, 6) AS score FROM e
""")
def score_ev(spark: SparkSession, d: str) -> DataFrame:
    """Scores in expectation after the constraint check, which moves the explicit mass of demoted rows."""
    rows = answers(spark, d).withColumn("state", sc.constraint_state(F.col("label2"), F.col("check")))
    explicit, partial = sc.constrained_probabilities(sc.p_of(F.col("probs2"), "explicit"), sc.p_of(F.col("probs2"), "partial"), F.col("state"))
    score = sc.score_by_expectation(explicit, partial, sc.p_of(F.col("probs"), "core"), F.col("market_cap_usd"), F.col("evidence"))
    return rows.select("company_key", "state", F.round(score, 6).alias("score"))


_TIER = """t AS (SELECT *, p_fact >= 0.6 AND product IN ('component', 'assembly_only', 'adjacent') AS c1, p_fact >= 0.6 AND role IN ('buyer_user', 'upstream', 'channel', 'minority_holder', 'other_link') AS c2, p_fact >= 0.6 AND has_document AND target = 'other_only' AS c3,
 label2 = 'explicit' AND product = 'own' AND role = 'supplier' AND (NOT has_document OR target IN ('named', 'one_of_several')) AS good FROM ans),
tt AS (SELECT *, CASE WHEN c1 OR c2 OR c3 THEN 'C' WHEN good THEN 'A' ELSE 'B' END AS tier FROM t)"""


def _facts() -> dict[str, tuple[Column, Column]]:
    return {f: (F.col(f), F.col("p_fact")) for f in ("product", "role", "target")}


@query(f"""
WITH {_ANSWERS}, {_TIER} SELECT company_key, tier, array_to_string(list_filter([CASE WHEN c1 THEN 'product:' || product END, CASE WHEN c2 THEN 'role:' || role END, CASE WHEN c3 THEN 'target:' || target END], lambda v: v IS NOT NULL), '; ') AS reasons,
CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN CASE WHEN was_rescued THEN 1 ELSE 2 END END AS place FROM tt
""")
def tier_order(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).withColumn("tier", sc.judged_tier(F.col("label2"), _facts(), F.col("has_document")))
    reasons = F.array_join(sc.counter_evidence(_facts(), F.col("has_document")), "; ")
    return rows.select("company_key", "tier", reasons.alias("reasons"), sc.tier_rank(F.col("tier"), F.lit(None).cast("string"), F.col("was_rescued")).alias("place"))


def facet_labels(rows: DataFrame) -> DataFrame:
    """Labels of three families for each company, some of them missing or read on older evidence."""
    k = F.concat(F.col("company_key"), F.lit("|facet"))
    each = []
    for i, (family, values) in enumerate(FACETS.items()):
        sha = F.when(_byte(k, 3 * i + 2) % 8 == 0, "old").otherwise(F.substring(F.md5("company_key"), 1, 8))
        each.append(F.struct(F.lit(family).alias("family"), _pick(values, F.floor(_byte(k, 3 * i) / 16).cast("int")).alias("value"), (F.greatest(_byte(k, 3 * i + 1), 255 - _byte(k, 3 * i + 1)) / 255).alias("p"), sha.alias("evidence_sha"), (_byte(k, 3 * i + 2) % 10 != 1).alias("there")))
    return rows.select("company_key", F.explode(F.array(*each)).alias("l")).where("l.there").select("company_key", "l.family", "l.value", "l.p", "l.evidence_sha")


_K = "company_key || '|facet'"
_LABELS = "lab AS (" + " UNION ALL ".join(
    f"SELECT company_key, '{f}' AS family, {_p(v, f'({_b(_K, 3 * i)} // 16)')} AS value, greatest({_b(_K, 3 * i + 1)}, 255 - {_b(_K, 3 * i + 1)}) / 255 AS p, CASE WHEN {_b(_K, 3 * i + 2)} % 8 = 0 THEN 'old' ELSE substring(md5(company_key), 1, 8) END AS evidence_sha FROM ans WHERE {_b(_K, 3 * i + 2)} % 10 <> 1"
    for i, (f, v) in enumerate(FACETS.items())
) + ")"
_SCOPE = """h AS (SELECT company_key, min(n) AS rule_no FROM (SELECT l.company_key, CASE WHEN family = 'role' AND value = 'reseller' THEN 1 WHEN family = 'scope' AND value = 'general_only' THEN 2 END AS n FROM lab l WHERE p >= 0.6 AND evidence_sha = substring(md5(company_key), 1, 8)) WHERE n IS NOT NULL GROUP BY 1),
seen AS (SELECT company_key, count(DISTINCT family) AS k FROM lab WHERE family IN ('role', 'scope') GROUP BY 1),
sco AS (SELECT a.*, CASE WHEN NOT was_rescued THEN rule_no END AS scope_rule, CASE WHEN NOT was_rescued THEN CASE rule_no WHEN 1 THEN 'remove' WHEN 2 THEN 'demote' END END AS scope_effect, NOT was_rescued AND coalesce(k, 0) < 2 AS scope_unchecked FROM ans a LEFT JOIN h USING (company_key) LEFT JOIN seen USING (company_key))"""


def _scoped(spark: SparkSession, rows: DataFrame) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "rule_no int, family string, value string, effect string")
    rows = rows.withColumn("evidence_sha", F.substring(F.md5("company_key"), 1, 8))
    return sc.apply_scope(rows, facet_labels(rows), rules, rows.where("was_rescued").select("company_key"))


@query(f"WITH {_ANSWERS}, {_LABELS}, {_SCOPE} SELECT company_key, scope_effect, scope_rule, scope_unchecked FROM sco")
def scope_demote(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, answers(spark, d)).select("company_key", "scope_effect", "scope_rule", "scope_unchecked")


@query(f"""
WITH {_ANSWERS}, {_LABELS}, l AS (SELECT DISTINCT company_key, family, value FROM lab WHERE p >= 0.7), c AS (SELECT family, value, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT family, n AS n_keep FROM c WHERE value IN ('maker', 'focused', 'inside')), n AS (SELECT count(*) AS total FROM ans),
f AS (SELECT family, value, n AS n_value, n_keep, row_number() OVER (ORDER BY n DESC, CASE family WHEN 'role' THEN 0 WHEN 'scope' THEN 1 ELSE 2 END, value) AS r FROM c JOIN k USING (family), n WHERE value NOT IN ('maker', 'focused', 'inside') AND n >= greatest(4, ceil(0.1 * total)) AND n_keep >= greatest(4, ceil(0.2 * total))),
o AS (SELECT b.r, count(*) AS shared, max(b.n_value) AS nb, a.r AS ra FROM f a JOIN l x ON x.family = a.family AND x.value = a.value JOIN l y ON y.company_key = x.company_key JOIN f b ON b.family = y.family AND b.value = y.value WHERE a.r < b.r GROUP BY 1, 4)
SELECT family, value, n_value, n_keep FROM f WHERE r NOT IN (SELECT r FROM o WHERE shared > 0.5 * nb) ORDER BY r LIMIT 2
""")
def split_detection(spark: SparkSession, d: str) -> DataFrame:
    """At most two questions on which the list parts; two is the feature."""
    rows = answers(spark, d)
    return sc.splits(rows, facet_labels(rows), {"role": "maker", "scope": "focused", "geo": "inside"})


@query(f"""
WITH {_ANSWERS}, {_LABELS}, {_RESCUE}, {_SCOPE}, {_TIER},
resc AS (SELECT company_key FROM r WHERE lean >= 0.30 ORDER BY has_document DESC, was_rescued DESC, lean DESC, coalesce(market_cap_usd, 0) DESC, security_id LIMIT 20),
v AS (SELECT g.company_key, g.security_id, g.market_cap_usd, CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS tr, scope_effect, CASE WHEN g.b15 % 32 = 16 THEN 'explicit' WHEN g.b15 % 32 = 5 THEN 'no' END AS verdict,
 round(CASE g.label2 WHEN 'explicit' THEN 3.0 ELSE 1.5 END * CASE WHEN g.evidence = 'profile' THEN 0.5 ELSE 1 END + 2 * g.core + CASE WHEN g.market_cap_usd > 0 THEN 0.01 * log10(g.market_cap_usd) ELSE 0 END, 6) AS score
 FROM gate g JOIN tt USING (company_key) JOIN sco USING (company_key) WHERE (g.passes OR g.company_key IN (SELECT company_key FROM resc)) AND g.label2 IN ('explicit', 'partial')),
w AS (SELECT *, CASE WHEN verdict = 'explicit' THEN 0 ELSE tr END AS place FROM v), bf AS (SELECT *, row_number() OVER (ORDER BY place, score DESC, coalesce(market_cap_usd, 0) DESC, security_id) AS before FROM w),
st AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN scope_effect = 'demote' AND coalesce(verdict, '') <> 'explicit' THEN 1 ELSE 0 END, place, score DESC, coalesce(market_cap_usd, 0) DESC, security_id) AS rank FROM bf WHERE coalesce(verdict, '') = 'explicit' OR (coalesce(scope_effect, '') <> 'remove' AND coalesce(verdict, '') <> 'no'))
SELECT rank, company_key, score, rank <= 40 AND before > 40 AND coalesce(verdict, '') <> 'explicit' AS backfill, rank > 40 AND coalesce(verdict, '') = 'explicit' AS below_cut FROM st WHERE rank <= 40 OR coalesce(verdict, '') = 'explicit'
""")
def screen_chain(spark: SparkSession, d: str) -> DataFrame:
    """All stages: gate, rescue, second answer, score, tiers, scope, hand-made verdicts, order and output of the first forty."""
    rows = checkpointed(answers(spark, d))  # read by four stages
    gated = rows.withColumn("passes", sc.passes_gate(F.col("status"), F.col("label"), F.col("probs"))).join(sc.rescued(rows).select("company_key", F.lit(True).alias("again")), "company_key", "left")
    read = gated.where((F.col("passes") | F.col("again").isNotNull()) & F.col("label2").isin("explicit", "partial"))
    score = sc.score_by_label(F.col("label2"), sc.p_of(F.col("probs"), "core"), F.col("market_cap_usd"), F.col("evidence"))
    pinned = _byte(F.col("company_key"), 15) % 32
    verdict = F.when(pinned == 16, "explicit").when(pinned == 5, "no")
    scored = read.withColumns({"score": F.round(score, 6), "verdict": verdict, "tier": sc.judged_tier(F.col("label2"), _facts(), F.col("has_document"))})
    scored = scored.withColumn("tier_rank", sc.tier_rank(F.col("tier"), F.col("verdict"), F.lit(False)))
    return sc.final_order(_scoped(spark, scored), 40).select("rank", "company_key", "score", "backfill", "below_cut")


# --- listings ---------------------------------------------------------------------------------------------------------


@query(r"""
WITH n AS (SELECT row_id, trim(regexp_replace(translate(regexp_replace(title, '<[^>]+>', '', 'g'), '（）【】：', '()():'), '\s+', ' ', 'g'), ' ') AS t FROM filing_rows),
m AS (SELECT row_id, t, regexp_extract(t, '^(.*?)((?:19|20)[0-9]{2})\s*年\s*(年?\s*度\s*报\s*告|年?\s*报)(.*)$', ['prefix', 'year', 'word', 'rest']) AS p FROM n WHERE regexp_matches(t, '(?:19|20)[0-9]{2}\s*年\s*(?:年?\s*度\s*报\s*告|年?\s*报)'))
SELECT row_id, CAST(p.year AS INTEGER) AS year, CASE WHEN p.rest LIKE '摘要%' OR (p.rest LIKE '(%' AND substring(p.rest, 1, 12) LIKE '%摘要%') THEN 'summary' ELSE 'full' END AS kind, regexp_matches(p.rest, '更新|修订|更正|补充|修正') AND NOT regexp_matches(p.rest, '(?:更新|修订|更正|补充|修正)前') AS revision
FROM m WHERE NOT regexp_matches(p.prefix, '关于|更正|补充|说明|通知|提示|H股|意见|审核|核查|董事会|监事会|独立|半年|季度|问询|回复|英文|取消|公告|摘要') AND regexp_matches(CASE WHEN p.rest LIKE '摘要%' THEN trim(substring(p.rest, 3), ' ') ELSE p.rest END, '^(?:全文|正文|\([^()]{0,20}\)|[\s\-—_:：、])*$') AND length(p.prefix) <= 40 AND p.prefix NOT LIKE '%:%'
""")
def title_grammar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filing_rows").select("row_id", ls.title_parts(F.col("title")).alias("t")).where(F.col("t").isNotNull())
    return rows.select("row_id", "t.year", "t.kind", "t.revision")


@query(r"""
WITH p AS (SELECT filer_code, filing_no, ingested_at, CAST(regexp_extract(title, '^((?:19|20)[0-9]{2})年', 1) AS INTEGER) AS year, CASE WHEN title LIKE '%摘要%' THEN 'summary' ELSE 'full' END AS kind FROM filing_rows WHERE filer_code IS NOT NULL AND regexp_matches(title, '^(?:19|20)[0-9]{2}年年度报告(摘要)?$')),
y AS (SELECT filer_code, max(year) AS year FROM p GROUP BY 1)
SELECT filer_code, year, kind, arg_max(filing_no, (ingested_at, filing_no)) AS filing_no, false AS revision FROM p JOIN y USING (filer_code, year) GROUP BY 1, 2, 3
""")
def select_reports(spark: SparkSession, d: str) -> DataFrame:
    return ls.newest_reports(table(spark, d, "filing_rows"), "filer_code", "title", "ingested_at", "filing_no")


@query("""
WITH f AS (SELECT *, form LIKE '%/A' AS amended FROM (SELECT filer_code, filing_no, ingested_at, CASE WHEN row_id % 5 = 0 THEN form || '/A' ELSE form END AS form FROM filing_rows WHERE form = '10-K' AND filer_code IS NOT NULL AND filing_no IS NOT NULL))
SELECT filer_code, arg_max(filing_no, (NOT amended, ingested_at, filing_no)) AS filing_no, arg_max(form, (NOT amended, ingested_at, filing_no)) AS form, bool_and(amended) AS amendment FROM f GROUP BY 1
""")
def latest_annual_filing(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the filings are marked as amendments, which the tables lack."""
    rows = table(spark, d, "filing_rows").withColumn("form", F.when(F.col("row_id") % 5 == 0, F.concat("form", F.lit("/A"))).otherwise(F.col("form")))
    return ls.latest_annual_filing(rows, "filer_code", "form", "ingested_at", "filing_no")


@query("SELECT security_id, trim(symbol) AS ticker, name, exchange FROM securities")
def parse_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Each exchange's lines as one JSON payload of fields and rows, and read again: a round trip of whole tables in blocks of a thousand lines."""
    lines = table(spark, d, "securities").select("security_id", "symbol", "name", "exchange", F.pmod(F.xxhash64("security_id"), F.lit(64)).alias("block"))
    cells = F.array("name", "symbol", "security_id", "exchange")
    payload = F.to_json(F.struct(F.array(*map(F.lit, ("name", "ticker", "id", "exchange"))).alias("fields"), F.collect_list(cells).alias("data")), {"ignoreNullFields": "false"})
    read = lines.groupBy("exchange", "block").agg(payload.alias("payload")).select(F.explode(ls.parse_columnar(F.col("payload"), "id string, ticker string, name string, exchange string, absent int")).alias("r"))
    return read.select(F.col("r.id").alias("security_id"), F.trim("r.ticker").alias("ticker"), "r.name", "r.exchange")


@query(r"SELECT listing_id, trim(regexp_replace(regexp_replace(upper(trim(ticker)), '[.\s/_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS ticker, CASE WHEN length(trim(id_isin)) = 12 THEN 'isin:' || trim(id_isin) ELSE 'sec:' || listing_id END AS company FROM profile_rows")
def ticker_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profile_rows").select("listing_id", ls.plain_ticker(F.col("ticker")).alias("ticker"), ls.listing_key(F.col("id_isin"), F.col("listing_id")).alias("company"))


# --- evidence, fields and relations -----------------------------------------------------------------------------------

TERMS = ["pressure valve", "battery cell", "machine tool", "freight software"]
WEAK = ["group", "company", "board", "customer"]
COUNTRIES = {"United States": "North America", "Japan": "Asia", "China": "Asia", "South Korea": "Asia", "India": "Asia", "United Kingdom": "Europe", "France": "Europe", "Germany": "Europe", "Spain": "Europe", "South Africa": "Africa"}
VENUES = {"NASDAQ": "North America", "NYSE": "North America", "JSE": "Africa", "LSE": "Europe", "KRX": "Asia", "TASE": "Middle East"}


def _like(t: str) -> str:
    return tx.term_pattern(t)


_PARAS = r"(SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS para FROM (SELECT doc_id, list_filter(list_transform(CASE WHEN len(b) < 4 THEN string_split(text, chr(10)) ELSE b END, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 80) AS p FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x, ' ') <> '') AS b FROM documents WHERE text IS NOT NULL)))"
_SCORE = " + ".join([f"CASE WHEN regexp_matches(para, '{_like(t)}') THEN 1.0 ELSE 0 END" for t in TERMS] + [f"CASE WHEN regexp_matches(para, '{_like(t)}') THEN 0.25 ELSE 0 END" for t in WEAK])


@query(f"SELECT doc_id, place, CAST(score AS DOUBLE) AS score, para AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM (SELECT doc_id, CAST(place AS INTEGER) AS place, {_SCORE} AS score, para FROM {_PARAS}) WHERE score >= 1) WHERE r <= 3")
def telling_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Up to three paragraphs of each document by weighted terms; three is the feature."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.explode(evidence.telling_paragraphs(F.col("text"), TERMS, WEAK)).alias("p")).select("doc_id", F.col("p.at").alias("place"), "p.score", "p.text")


@query()
def evidence_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Opening, keyword and description excerpts of each document beside its company's profile; tested on literal texts."""
    profiles = table(spark, d, "documents").where((F.col("source") == "profile_page") & F.col("company_key").isNotNull()).groupBy("company_key").agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("profile"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "company_key", "text").join(profiles, "company_key", "left")
    return docs.select("doc_id", F.explode(evidence.excerpts(F.col("text"), TERMS, WEAK, F.col("profile"))).alias("e")).select("doc_id", "e.kind", "e.text")


_HEAVY = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in evidence.RESULT_WORDS)


@query(rf"""
SELECT doc_id, coalesce(d / nullif(length(text), 0) >= 0.12 OR (d / nullif(length(text), 0) >= 0.05 AND {_HEAVY} >= 2), false) AS figure_heavy, regexp_matches(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]') OR (l > 0 AND n * 2 < l) AS other_script,
len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{{5,}}'))) AS long_words, len(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\-]*')), lambda w: regexp_matches(w, '[A-Z0-9].*[A-Z0-9]') AND regexp_matches(w, '[A-Z]'))) AS anchors
FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '\p{{Nd}}+', '', 'g')) AS d, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS l, length(regexp_replace(text, '[^\p{{Latin}}]+', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
""")
def text_marks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    counts = [F.size(c).cast("long").alias(n) for c, n in ((evidence.description_words(t), "long_words"), (evidence.latin_anchors(t), "anchors"))]
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", evidence.figure_heavy(t).alias("figure_heavy"), fields.not_english(t).alias("other_script"), *counts)


def _case(table_: dict, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


@query(f"SELECT region, count(*) AS lines, count(DISTINCT company_key) AS companies FROM (SELECT coalesce(CASE WHEN country NOT IN ('United Kingdom') THEN {_case(COUNTRIES, 'country')} END, {_case(VENUES, 'exchange')}, {_case(COUNTRIES, 'country')}, 'Other') AS region, company_key FROM securities) GROUP BY 1")
def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Lines by region; one country is taken as a mere seat, so its lines go by their venue first."""
    region = fields.region_for(F.col("country"), F.col("exchange"), COUNTRIES, VENUES, ("United Kingdom",))
    return table(spark, d, "securities").groupBy(region.alias("region")).agg(F.count("*").alias("lines"), F.count_distinct("company_key").alias("companies"))


@query(r"""
SELECT obs_id, CASE WHEN v IS NULL THEN '-' WHEN abs(v) >= 1e12 THEN printf('%.1fT', v / 1e12) WHEN abs(v) >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) ELSE format('{:,}', CAST(round_even(v, 0) AS BIGINT)) END AS words,
CASE WHEN floor(v * 0.98) > 0 THEN CAST(floor(v * 0.98) AS BIGINT) - CAST(floor(v * 0.98) AS BIGINT) % CAST(pow(10, greatest(0, length(CAST(CAST(floor(v * 0.98) AS BIGINT) AS VARCHAR)) - 2)) AS BIGINT) ELSE 0 END AS floor_value FROM (SELECT obs_id, floor(market_cap_usd / 1000) * 1000 + 1 AS v FROM market_daily)
""")
def money_fields(spark: SparkSession, d: str) -> DataFrame:
    v = F.floor(F.col("market_cap_usd") / 1000) * 1000.0 + 1  # no figure stands half-way between two
    return table(spark, d, "market_daily").select("obs_id", fields.money_words(v).alias("words"), fields.lower_floor(v).alias("floor_value"))


@query(" UNION ALL ".join(
    f"SELECT '{r}' AS relation, count(*) AS rows, count(*) FILTER (WHERE {' OR '.join(f'{k} IS NULL' for k in schemas.RELATIONS[r][1])}) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM {r} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in schemas.RELATIONS[r][1])} GROUP BY {', '.join(schemas.RELATIONS[r][1])} HAVING count(*) > 1)) AS repeated_keys FROM {r}"
    for r in ("sources", "snapshots", "securities", "market_daily", "documents")
))
def relation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Tables brought into the store's relations, and what their keys lack."""
    out = None
    for r in ("sources", "snapshots", "securities", "market_daily", "documents"):
        part = schemas.key_faults(schemas.conform(table(spark, d, r), r), r)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT security_id, CAST(as_of AS VARCHAR) AS as_of, close_price FROM (SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY obs_id % 2 DESC, fetched_at DESC NULLS LAST, close_price DESC NULLS LAST) AS r FROM market_daily WHERE security_id IS NOT NULL AND as_of IS NOT NULL) WHERE r = 1")
def market_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Odd rows delivered after even ones: of each line and day the newer delivery holds, within one the later fetch."""
    rows = table(spark, d, "market_daily")
    after = schemas.upsert(rows.where(F.col("obs_id") % 2 == 0), rows.where(F.col("obs_id") % 2 == 1), "market_daily", ["fetched_at", "close_price"])
    return after.select("security_id", F.col("as_of").cast("string").alias("as_of"), "close_price")
