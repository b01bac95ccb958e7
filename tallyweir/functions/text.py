"""Text functions as column expressions; Arrow functions only where built-ins can't say it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code-point classes of the scripts that are counted, and what a language's verdict needs of them.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
KANA = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}]"
HANGUL = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}]"
LATIN = r"[A-Za-z]"
LANGUAGE_PREFIX = 20_000  # a language is told by so many first characters
LEAST_LETTERS = 20
# Marks that end a sentence, brackets that may close after them, and the words before a point that number an entry.
WIDE_STOPS, WIDE_CLOSERS = "。！？", "」』）)"
ENUMERATORS = "[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4}|[가나다라마바사아자차카타파하]"
CJK_LANGUAGES = ("zh", "ja", "ko")
# Endings that a term's last word may take.
ENDINGS = ("s", "es", "ic", "ics", "al", "ed", "ing")


def normalised(col: Column) -> Column:
    """Lower case, blanks collapsed, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")))


def script_counts(col: Column) -> dict[str, Column]:
    """Counts of characters by script."""
    return {k: F.coalesce(F.regexp_count(col, F.lit(p)), F.lit(0)) for k, p in (("han", HAN), ("kana", KANA), ("hangul", HANGUL), ("latin", LATIN))}


def detect_language(col: Column, default: str | None = None) -> Column:
    """Language told by script: ko, ja, zh or en; ``default`` where too few letters tell."""
    n = script_counts(F.substring(col, 1, LANGUAGE_PREFIX))
    chinese_or_kana = n["han"] + n["kana"]
    half = LEAST_LETTERS // 2
    korean = (n["hangul"] >= half) & (10 * n["hangul"] >= 3 * (chinese_or_kana + n["hangul"])) & (5 * n["hangul"] >= n["latin"])
    eastern = (chinese_or_kana >= half) & (5 * chinese_or_kana >= n["latin"])
    told = F.when(korean, "ko").when(eastern & (10 * n["kana"] >= chinese_or_kana), "ja").when(eastern, "zh").when(n["latin"] >= LEAST_LETTERS, "en")
    return F.coalesce(F.when(chinese_or_kana + n["hangul"] + n["latin"] >= LEAST_LETTERS, told), F.lit(default))


def truncate_words(col: Column, n: int, lang: Column | None = None) -> Column:
    """At most ``n`` characters with an ellipsis; cut at the last blank if it lies beyond three fifths.

    A text whose ``lang`` is zh, ja or ko is cut after its last sentence that ends beyond three fifths; failing that, Korean at a
    blank as above, Chinese and Japanese anywhere, since their blanks stand inside foreign names only.
    """
    flat = F.trim(F.regexp_replace(col, r"[ \t]+", " "))
    head = F.substring(flat, 1, n - 1)
    blank = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    at_word = F.when((F.instr(head, " ") > 0) & (blank > 0.6 * n), head.substr(F.lit(1), blank)).otherwise(head)
    short = F.regexp_replace(at_word, r"[ ,;:]+$", "")
    if lang is not None:
        # Java looks behind for a bounded length, as long as the longest enumerator
        stop = rf"[{WIDE_STOPS}][{WIDE_CLOSERS}]*|[!?](?=\s)|(?<!(?:^|[ \n　])(?:{ENUMERATORS}))\.(?=\s)"
        sentences = F.regexp_extract(head, rf"(?s)^(.*(?:{stop}))", 1)
        eastern = F.when(F.length(sentences) > 0.6 * n, sentences).when(lang != "ko", F.rtrim(head)).otherwise(short)
        short = F.when(lang.isin(*CJK_LANGUAGES), eastern).otherwise(short)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(short, F.lit("…")))


def paragraphs(col: Column, least: int = 80) -> Column:
    """Paragraphs between blank lines (lines where these are fewer than four), blanks collapsed, short ones dropped."""
    blocks = F.filter(F.split(col, r"\n[ \t]*\n"), lambda x: F.trim(x) != "")
    chosen = F.when(F.size(blocks) < 4, F.split(col, "\n")).otherwise(blocks)
    flat = F.transform(chosen, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(flat, lambda x: F.length(x) >= least)


def _either_width(c: str, any_case: bool) -> str:
    """A pattern for a character in its narrow or full width; ignoring case goes for ASCII only, so full-width letters come in both."""
    if "!" <= c <= "~":
        forms = sorted({c.lower(), c.upper()} if any_case else {c})
        wide = "".join(chr(ord(x) - ord("!") + ord("！")) for x in forms)
        return f"[{c}{wide}]" if c.isalnum() else f"[\\{c}{wide}]"
    return c


def term_pattern(term: str) -> str:
    """A pattern for a term in running text, in what Java's and RE2's expressions share (no looking around).

    * Written in capitals and figures only, up to five of them: the very capitals, at most with a plural s.
    * Latin words: as whole words whatever the case, any blanks between them, the last one inflected by ``ENDINGS`` if it has three
      letters or more, else by a plural s.
    * Anything else: its characters in order with blanks allowed between them, whole words only where a Latin letter begins or ends it.
    """
    term = unicodedata.normalize("NFKC", term).strip()
    edge = "A-Za-z0-9Ａ-Ｚａ-ｚ０-９"
    before, after = f"(?:^|[^{edge}])", f"(?:$|[^{edge}])"
    words = term.split()
    if not words:
        return "a^"
    if not term.isascii():
        body = r"\s*".join(_either_width(c, True) for w in words for c in w)
        starts, ends = (c.isascii() and c.isalnum() for c in (term[0], term[-1]))
        return "(?i)" + before * starts + body + after * ends
    acronym = len(words) == 1 and 2 <= len(term) <= 5 and term.isupper() and term.isalnum()
    drawn = ["".join(_either_width(c, not acronym) for c in w) for w in words]
    if acronym:
        return f"{before}{drawn[0]}[sｓ]?{after}"
    endings = "|".join(ENDINGS) if len(words[-1]) >= 3 else "s"
    return "(?i)" + before + r"\s+".join(drawn) + f"(?:{endings})?" + after


def bigrams(col: Column) -> Column:
    """Distinct pairs of neighbouring characters of the text in any script, without blanks and marks, lower case; a single character by itself."""
    bare = F.lower(F.regexp_replace(col, r"[^\p{L}\p{M}\p{N}]", ""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: bare.substr(i, F.lit(2)))
    return F.when(F.length(bare) >= 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two distinct arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def html_text(col: Column) -> Column:
    """Visible text of an HTML page: scripts, styles and comments dropped, tags to blanks, common entities read."""
    bare = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(col: Column) -> Column:
    """Text of the title element, null where there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(col, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    """Compatible forms and case folding, which no built-in offers."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def content_sha(col: Column, digits: int = 16) -> Column:
    """First hex digits of the SHA-256 of a text after a leading tag line in square brackets."""
    return F.substring(F.sha2(F.regexp_replace(col, r"^\[[^\]\n]*\]\n", ""), 256), 1, digits)
