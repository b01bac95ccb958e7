"""Which parts of a long text a reader should see: paragraphs by the terms they hold, windows around hits, openings, anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweir.functions.text import paragraphs, term_pattern, truncate_words

WEAK_WEIGHT = 0.25  # of a term that says little by itself
# Words of results in Chinese, Japanese and Korean reports.
RESULT_WORDS = ("营业收入", "营业总收入", "净利润", "同比", "较去年同期", "较上年", "比上年", "万元", "亿元", "売上高", "売上収益", "営業利益", "経常利益", "純利益", "百万円", "億円", "前期比", "前年同期比", "매출액", "영업이익", "순이익", "당기순이익", "억원", "백만원", "전년 대비", "전년대비")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row: Spark would put a copy of its expression in each place of its use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(col: Column, chars: str) -> Column:
    """Number of characters of a class; runs are struck out at once."""
    return F.length(col) - F.length(F.regexp_replace(col, f"(?:{chars})+", ""))


def figure_heavy(paragraph: Column) -> Column:
    """Whether figures make up a paragraph: 12 % digits, or 5 % beside two words of results."""
    share = F.try_divide(_count(paragraph, r"\p{Nd}"), F.length(paragraph))
    words = sum((F.contains(paragraph, F.lit(w)).cast("int") for w in RESULT_WORDS[1:]), F.contains(paragraph, F.lit(RESULT_WORDS[0])).cast("int"))
    return F.coalesce((share >= 0.12) | ((share >= 0.05) & (words >= 2)), F.lit(False))


def term_score(text: Column, terms: list[str], weak: list[str] | None = None) -> Column:
    """Number of distinct terms in a text, weak ones counting a quarter."""
    score = F.lit(0.0)
    for t in terms:
        score = score + text.rlike(term_pattern(t)).cast("double")
    for t in weak or []:
        score = score + text.rlike(term_pattern(t)).cast("double") * WEAK_WEIGHT
    return score


def telling_paragraphs(text: Column, terms: list[str], weak: list[str] | None = None, most: int = 3, least: int = 80, seen: Column | None = None) -> Column:
    """Array of struct(at, score, text): the ``most`` paragraphs with the highest score of at least 1, in the order of the text.

    ``seen`` is an array of pieces that the reader knows (see ``shown_pieces``): paragraphs that hold one are left out.
    """
    placed = F.transform(paragraphs(text, least), lambda p, i: F.struct(term_score(p, terms, weak).alias("score"), (-i).alias("back"), p.alias("text")))
    told = F.filter(placed, lambda x: x["score"] >= 1)
    if seen is not None:
        told = F.filter(told, lambda x: ~F.exists(seen, lambda s: F.contains(F.regexp_replace(x["text"], r"\s+", ""), s)))
    best = F.slice(F.sort_array(told, asc=False), 1, most)
    return F.array_sort(F.transform(best, lambda x: F.struct((-x["back"]).alias("at"), x["score"].alias("score"), x["text"].alias("text"))))


def shown_pieces(excerpts: Column) -> Column:
    """Pieces of 20 characters, one every 40, of the texts that were shown, without blanks and ellipses."""
    flat = F.transform(excerpts, lambda e: F.regexp_replace(e, r"[\s…]+", ""))
    cut = F.transform(flat, lambda t: F.when(F.length(t) >= 20, F.transform(F.sequence(F.lit(1), F.length(t) - 19, F.lit(40)), lambda i: F.substr(t, i, F.lit(20)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(cut))


def window(paragraph: Column, terms: list[str], chars: int) -> Column:
    """At most ``chars`` characters of a paragraph around its first hit: from a third of that before it, at a word's start."""
    first = F.lit(None).cast("int")
    for t in terms:
        before = F.length(F.get(F.split(paragraph, term_pattern(t), 2), F.lit(0)))
        first = F.least(first, F.when(paragraph.rlike(term_pattern(t)), before))
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - chars // 3)
    head = F.substr(paragraph, F.lit(1), start)
    blank = F.length(head) - F.instr(F.reverse(head), " ") + 1
    start = F.when((start > 0) & (F.instr(head, " ") > 0), blank).otherwise(F.lit(0))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(paragraph, start + 1, F.length(paragraph)))
    return F.when(F.length(paragraph) <= chars, paragraph).otherwise(truncate_words(cut, chars))


def description_words(col: Column, stop: list[str] | None = None) -> Column:
    """Distinct lower-case Latin words of six letters and more, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([a-z][a-z\-]{5,})"), F.lit(1)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def excerpts(text: Column, terms: list[str], weak: list[str] | None = None, description: Column | None = None, chars: int = 700, opening: int = 250, least: int = 80) -> Column:
    """Array of struct(kind, text), at most three: the opening paragraphs, the paragraph with the most terms, the one closest to a description.

    No paragraph is used twice. A text without paragraphs of its own gives its beginning.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.lit(None) if description is None else description_words(description)

    def told(paras: Column) -> Column:
        # the opening: paragraphs until it is long enough
        lengths = F.aggregate(paras, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, p: F.when(a["n"] >= opening, a).otherwise(F.struct((a["n"] + F.length(p) + 1).cast("int").alias("n"), (a["k"] + 1).alias("k"))))
        return _let(lengths["k"], lambda taken: after(paras, taken))

    def after(paras: Column, taken: Column) -> Column:
        overview = truncate_words(F.when(taken > 0, F.array_join(F.slice(paras, 1, F.greatest(taken, F.lit(1))), " ")).otherwise(flat), chars)
        scored = F.filter(F.transform(paras, lambda p, i: F.struct(term_score(p, terms, weak).alias("score"), (-i).alias("back"), p.alias("text"))), lambda x: (x["score"] >= 1) & (-x["back"] >= taken))
        opened = _let(overview, lambda o: F.when(o != "", F.struct(F.lit("overview").alias("kind"), o.alias("text"))))
        return F.concat(F.array(opened), _let(F.array_max(scored), lambda best: beside(paras, taken, best)))

    def beside(paras: Column, taken: Column, best: Column) -> Column:
        keywords = F.when(best.isNotNull(), F.struct(F.lit("keywords").alias("kind"), window(best["text"], [*terms, *(weak or [])], chars).alias("text")))
        if description is None:
            return F.array(keywords)
        return F.array(keywords, _let(words, lambda known: F.when(F.size(known) > 0, closest(paras, taken, best, known))))

    def closest(paras: Column, taken: Column, best: Column, known: Column) -> Column:
        close = F.filter(F.transform(paras, lambda p, i: F.struct(F.size(F.array_intersect(description_words(p), known)).alias("score"), (-i).alias("back"), p.alias("text"))), lambda x: (x["score"] >= 2) & (-x["back"] >= taken) & ~x["back"].eqNullSafe(best["back"]))
        return _let(F.array_max(close), lambda near: F.when(near.isNotNull(), F.struct(F.lit("description").alias("kind"), truncate_words(near["text"], chars).alias("text"))))

    return F.array_compact(_let(paragraphs(text, least), told))


def latin_anchors(col: Column, generic: tuple[str, ...] = ()) -> Column:
    """Distinct Latin tokens with two capitals or figures and a capital among them, as other scripts take them over unchanged."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]*)"), F.lit(1)))
    return F.filter(tokens, lambda w: w.rlike("[A-Z0-9].*[A-Z0-9]") & w.rlike("[A-Z]") & ~F.upper(w).isin(*generic, ""))
