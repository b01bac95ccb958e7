"""Sentence boundaries across languages and scripts (problem 5).

A text is a chain of candidate boundaries: after closing marks, at line breaks and, in scripts without marks, at blanks.
Semi-Markov dynamic programming picks the chain of whole spans with the highest score; a span's score joins its opening
word, its closing word or mark, its length and the balance of its quotation marks and brackets. The word scores are
log-odds counted over the whole corpus at places that are surely boundaries (text starts, blank lines, marks before a new
line) and places that surely aren't (between plain words).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.scans import roman
from tallyweir.session import ship_package

MIN_COUNT = 2
SPAN_BASE, LONG_SPAN = -1.5, 400  # score of any span; characters from which a span is unlikely the longer it is

# Marks and brackets.
TERMINALS = ".!?。！？｡।॥؟۔…‥．"
CLOSERS = "\"'”’»›」』）)】］]〉》〕"
OPENERS = "\"'“‘„«‹「『（(【［[〈《〔¿¡"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "［": "］", "[": "]", "〈": "〉", "《": "》", "〔": "〕", "‘": "’"}
# Abbreviations that a name, number or further word follows.
TITLES = frozenset("no nos nr fig figs art sec vol pp p pg pág cf vgl ca approx aprox env dept apdo st ste mt mr mrs gen col hon rev capt lt sgt univ ms dr prof sr jr núm núms tel ext ed eds ch para abs z bzw ggf inkl usw zzgl jan feb mar apr jun jul aug sept sep oct nov dec e.g i.e vs viz resp mio mrd tsd rs रु सं डॉ श्री".split())

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]")
_THAI = re.compile(r"[฀-๿຀-໿က-႟ក-៿]")
# where a boundary may stand: marks and line ends, in scripts without marks blanks too
_SPOT = re.compile(rf"[{re.escape(TERMINALS)}\n]")
_SPOT_THAI = re.compile(rf"[{re.escape(TERMINALS)}\s]")
_BRACKETS = re.compile("[\"\n" + re.escape("".join(sorted({*PAIRS, *"".join(PAIRS.values())}))) + "]")
_WORD = re.compile(r"[^\W_]+(?:[.'’&-][^\W_]+)*", re.UNICODE)
# Signs before list entries, words before their numbers, figures of counting in Chinese and counting syllables in Korean.
BULLETS = "-•*–—・●○▪"
ENTRY_WORDS = ("item", "article", "art", "art.")
HAN_FIGURES = "一二三四五六七八九十"
KOREAN_COUNTERS = "가나다라마바사아자차카타파하"
ROMAN_NUMBERS = {roman(n) for n in range(1, 40)}


def _is_counter(core: str) -> bool:
    """Whether a word without its point or bracket counts entries: a short number, a letter, a Roman or Chinese number, a Korean counter."""
    if core.isascii():
        return core.isdigit() and len(core) <= 3 or core.isalpha() and (len(core) == 1 or core.lower() in ROMAN_NUMBERS)
    return core in KOREAN_COUNTERS or len(core) <= 3 and all(c in HAN_FIGURES for c in core)


def is_enumerator(piece: str) -> bool:
    """Whether a piece of text is nothing but what numbers an entry: a bullet, a counter with its mark (1.2) too), or a word and a number."""
    words = piece.split()
    if not words or len(words) > 2:
        return False
    if len(words) == 2 or words[0].lower().startswith("art.") and len(words[0]) > 4:
        word, number = (words[0].lower(), words[1]) if len(words) == 2 else ("art.", words[0][4:])
        letter = number[-2:-1] if word == "item" else ""
        number = number[:-2] if letter.isalpha() and letter.isupper() else number[:-1] if number.endswith(".") else ""
        return word in ENTRY_WORDS and number.isascii() and number.isdigit() and words[-1].endswith(".")
    bare = words[0]
    if bare in BULLETS and len(bare) == 1:
        return True
    if bare[-1] not in ".)）、．":
        return False
    first, *more = [x for x in re.split(r"[.)）、．]", bare.lstrip("(（"))][:-1]
    return len(bare) - len(bare.lstrip("(（")) <= 1 and bool(first) and _is_counter(first) and all(x.isascii() and x.isdigit() and len(x) <= 2 for x in more)


def begins_entry(text: str, at: int) -> bool:
    """Whether a line that begins at a place opens with a bullet or a number and a blank after it; numbers in Chinese need none."""
    head = text[at : at + 9]
    word = re.match(r"\S*", head)[0]
    if head[:1] in "(（" and (close := re.match(r"[(（](.{1,3})[)）]", head)) and all(c in HAN_FIGURES for c in close[1]):
        return True
    follows = head[len(word) : len(word) + 1].isspace()
    if word.lower() == "item":
        return follows and head[len(word) + 1 : len(word) + 2].isdigit()
    core = word.lstrip("(（").rstrip(".)）")
    numbered = core.isascii() and core.isdigit() and len(core) <= 2 or len(core) == 1 and core in KOREAN_COUNTERS
    return follows and (word in BULLETS and len(word) == 1 or numbered and len(core) < len(word) and word[-1] in ".)）")


def opening_key(text: str, at: int) -> str:
    """The word that begins at a place; in scripts without blanks its first characters."""
    while at < len(text) and (text[at] in OPENERS or text[at].isspace()):
        at += 1
    if at >= len(text):
        return ""
    c = text[at]
    if _THAI.match(c):
        return text[at : at + 5]
    if _CJK.match(c):
        return text[at : at + 2]
    m = _WORD.match(text, at)
    return re.sub(r"[0-9]+", "0", m[0])[:24] if m else c


def closing_key(text: str, end: int) -> str:
    """The word that ends before a place, without marks."""
    while end > 0 and (text[end - 1] in CLOSERS or text[end - 1] in TERMINALS or text[end - 1].isspace()):
        end -= 1
    if end <= 0:
        return ""
    c = text[end - 1]
    if _THAI.match(c):
        return text[max(0, end - 4) : end]
    if _CJK.match(c):
        return text[max(0, end - 2) : end]
    start = end
    while start > 0 and end - start < 24 and (text[start - 1].isalnum() or (text[start - 1] in ".'’-&" and start > 1 and text[start - 2].isalnum())):
        start -= 1
    return re.sub(r"[0-9]+", "0", text[start:end])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words at sure boundaries and sure non-boundaries: os, oi (opening), cs, ci (closing), ab (before a mark that does not end)."""
    for pdf in batches:
        c: Counter = Counter()
        for text in pdf["text"]:
            if not text or not text.strip():
                continue
            for block in re.split(r"\n[^\S\n]*\n", text):
                s = block.strip()
                if not s:
                    continue
                c["os", opening_key(s, 0)] += 1
                if s[-1] in TERMINALS or s[-1] in CLOSERS:
                    c["cs", closing_key(s, len(s))] += 1
                for m in re.finditer(r"([^\W\d_]{3,}|[0-9]{4})[!?।。！？]\s+(?=[^\s%s])" % re.escape(CLOSERS), s):
                    c["os", opening_key(s, m.end())] += 1
                    c["cs", closing_key(s, m.end(1))] += 1
                for m in re.finditer(r"([a-zà-ÿ]{4,})\.\s+(?=[^\Wa-zà-ÿ])", s):
                    c["os", opening_key(s, m.end())] += 1
                    c["cs", closing_key(s, m.end(1))] += 1
                # between two plain words nothing ends
                for m in re.finditer(r"([^\W\d_]+|[0-9,.%]*[0-9%])[^\S\n]([^\W_]+)", s):
                    if _THAI.match(m[2][0]):
                        c["oi", opening_key(s, m.start(2))] += 1
                    elif not _CJK.match(m[2][0]):
                        c["oi", opening_key(s, m.start(2))] += 1
                        c["ci", closing_key(s, m.end(1))] += 1
                for m in re.finditer(r"(?<=[぀-鿿])(?=[぀-鿿]{2})", s):
                    c["oi", s[m.start() : m.start() + 2]] += 1
                for m in re.finditer(r"([^\W_]+(?:\.[^\W_]+)*)\.[%s]*[^\S\n]+([^\W_])" % re.escape(CLOSERS), s):
                    low = m[2].islower() or m[2].isdigit()
                    c["ab" if low else "ac", closing_key(s, m.end(1))] += 1
        rows = [(k, w, n) for (k, w), n in c.items() if w]
        yield pd.DataFrame(rows, columns=["kind", "word", "n"])


def boundary_model(texts: DataFrame, text: str = "text") -> dict[str, dict[str, int]]:
    """Counts of opening and closing words over all texts, as kind -> word -> count.

    All texts are counted, and every entry met ``MIN_COUNT`` times is kept: the model grows with the vocabulary.
    """
    ship_package(texts.sparkSession)
    counted = texts.select(F.col(text).alias("text")).mapInPandas(_counts, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    model: dict[str, dict[str, int]] = {}
    for r in counted.where(F.col("n") >= MIN_COUNT).toLocalIterator():
        model.setdefault(r["kind"], {})[r["word"]] = r["n"]
    return model


class Splitter:
    """Divides one text after another by a word model."""

    def __init__(self, model: dict[str, dict[str, int]]):
        self.start, self.inner, self.end, self.mid, self.abbr, self.stop = (model.get(k, {}) for k in ("os", "oi", "cs", "ci", "ab", "ac"))

    def opening(self, key: str) -> float:
        """Log-odds that a word opens a sentence."""
        s, i = self.start.get(key, 0), self.inner.get(key, 0)
        # scripts without blanks: an opening never seen is a sign against one
        score = math.log((s + (0.1 if _CJK.match(key[:1]) else 0.5)) / (i + 0.5))
        score = max(-3.0, min(3.0, score))
        if key[:1].islower() and s == 0:
            score -= 2.0
        return score

    def closing(self, key: str) -> float:
        """Log-odds that a word closes a sentence."""
        s, i = self.end.get(key, 0), self.mid.get(key, 0)
        return max(-2.0, min(2.0, math.log((s + 0.5) / (i + 0.5))))

    def mark(self, text: str, at: int, end: int) -> float:
        """Score of a run of closing marks text[at:end) as an end, from the mark and the word before it."""
        run = text[at:end]
        if any(c in "。！？｡।॥؟۔" for c in run):
            return 5.0
        if any(c in "!?" for c in run):
            return 3.5
        if "…" in run or "‥" in run or run.count(".") >= 2:
            return -2.5
        if text[at - 1 : at] in tuple(CLOSERS) and at > 1:
            return 3.0
        key = closing_key(text, at)
        low = key.lower()
        if key in ("0",) or low in ("0",):
            digits = re.search(r"([0-9][0-9.,]*)$", text[max(0, at - 16) : at])
            number = digits[1] if digits else ""
            before = text[: at - len(number)].rstrip()[-1:]
            if re.search(r"(?:^|[\s(（])(?:no|nr|note|fig|art|item|line|núm)\.?\s*$", text[max(0, at - len(number) - 8) : at - len(number)], re.I):
                return 0.5
            return 2.5 if len(number) >= 3 else (0.0 if before and before.isalpha() else 1.0)
        if low in TITLES:
            return -6.0
        ab, ac = self.abbr.get(key, 0), self.stop.get(key, 0)
        dotted = "." in key
        if len(key) == 1 and key.isalpha():
            return -3.0 if not dotted else 0.0
        ratio = math.log((ac + 1.0) / (ab + 1.0))
        follow = text[end : end + 64].lstrip()[:1]
        if follow and (follow.islower() or follow.isdigit()) and self.start.get(opening_key(text, end), 0) < 2:
            return -4.0
        if dotted:
            return 1.5
        # a word that usually goes on in small letters or figures after its point ends a sentence before a capital
        return 3.0 if follow.isupper() or ratio > 0.5 or ab <= 2 else max(-3.0, ratio)

    def candidates(self, text: str) -> list[tuple[int, float, int]]:
        """(end, score of the mark or break, start of what follows) in order."""
        out: list[tuple[int, float, int]] = []
        n = len(text)
        thai = len(_THAI.findall(text)) > 0.3 * n
        ragged = self.ragged(text)
        spot = _SPOT_THAI if thai else _SPOT
        i = 0
        while (found := spot.search(text, i)) is not None:
            i = found.start()
            c = text[i]
            if c in TERMINALS:
                j = i + 1
                while j < n and text[j] in TERMINALS:
                    j += 1
                e = j
                while e < n and text[e] in CLOSERS:
                    if text[e] in "\"'" and not self._closes(text, e):
                        break
                    e += 1
                k = e
                while k < n and text[k].isspace():
                    k += 1
                wide = any(x in "。！？｡।॥؟۔" for x in text[i:j])
                # a mark without a blank ends a sentence only where a capitalised word or a quotation follows a whole word
                glued = k == e and not wide and re.match(r"[%s]?[A-ZÀ-ÞА-Я][a-zà-ÿа-я]|[%s][A-Z]|[A-Z] [a-z]|[a-z][A-Z][a-z]|[가-힣]" % (re.escape(OPENERS), re.escape(OPENERS)), text[k : k + 3] if not "가" <= text[i - 1 : i] <= "힣" else "가") and re.search(r"[^\W_]{2}$|[A-Za-z]\.[A-Za-z]$|[0-9%]$|\W$", text[max(0, i - 3) : i])
                if k >= n or k > e or wide or glued:
                    score = self.mark(text, i, j)
                    if k == e and e == j and wide:
                        score += 1.0
                    if e > j and k == e and k < n:
                        score -= 2.2  # closing quotation without a blank: usually the sentence goes on
                    elif e > j and k < n:
                        score -= 0.3 if text[k].isupper() else 1.5
                    if "\n" in text[e:k]:
                        score += self.line_break(text, e, k, ragged, True)
                    out.append((e, score, k))
                i = max(k, j) if k > e else e
                continue
            if c == "\n":
                e = i
                while e > 0 and text[e - 1].isspace():
                    e -= 1
                k = i
                while k < n and text[k].isspace():
                    k += 1
                if e > 0 and k < n and (not out or out[-1][2] != k):
                    out.append((e, self.line_break(text, e, k, ragged, False), k))
                i = max(k, i + 1)
                continue
            if thai and c.isspace() and i and i + 1 < n and not text[i - 1].isspace():
                k = i
                while k < n and text[k].isspace():
                    k += 1
                if "\n" not in text[i:k] and k < n:
                    out.append((i, self.thai_blank(text, i, k), k))
                    i = k
                    continue
            i += 1
        return out

    def _closes(self, text: str, at: int) -> bool:
        """Whether a straight quotation mark closes: an odd number of them came before in its paragraph."""
        start = text.rfind("\n\n", 0, at) + 1
        if text[at] == "'":
            return at + 1 >= len(text) or not text[at + 1].isalnum()
        return text.count('"', start, at) % 2 == 1

    def ragged(self, text: str) -> bool:
        """Whether lines break inside sentences: a line begins in mid-sentence after one that no mark ends."""
        for m in re.finditer(r"([^\s])[^\S\n]*\n[^\S\n]*(\S+)", text):
            if m[1] in ",、，;" or (m[1] not in TERMINALS and m[1] not in CLOSERS and m[2][0].islower() and self.start.get(opening_key(m[2], 0), 0) < 2):
                return True
            if (_THAI.match(m[2][0]) or _CJK.match(m[2][0]) or "ऀ" <= m[2][0] <= "ॿ" or "가" <= m[2][0] <= "힣") and m[1] not in TERMINALS and m[1] not in CLOSERS and self.start.get(opening_key(text, m.start(2)), 0) == 0 and not is_enumerator(m[2]):
                return True
        return False

    def line_break(self, text: str, e: int, k: int, ragged: bool, marked: bool) -> float:
        if text.count("\n", e, k) > 1:
            return 12.0  # a blank line ends whatever came before
        tagged = text[e - 1] in "]】" and re.search(r"^[\[【][^\n\]】]*[\]】]$", text[text.rfind("\n", 0, e) + 1 : e]) is not None
        if tagged:
            return 9.0
        if not ragged and begins_entry(text, k):
            return 8.0
        if not ragged:
            return 6.0
        return 0.0 if marked else -0.5 + 0.5 * self.closing(closing_key(text, e))

    def thai_blank(self, text: str, e: int, k: int) -> float:
        key = opening_key(text, k)
        s, i = self.start.get(key, 0), self.inner.get(key, 0)
        if s < 2 or text[k].isdigit() or not _THAI.match(text[k]):
            return -6.0
        return 3.5 if s * 10 >= i else -3.0

    def ends(self, text: str | None) -> list[int]:
        """Ends (code points, closing marks included) of the sentences of a text; none for null and blank texts."""
        if not text or not text.strip():
            return []
        last = len(text.rstrip())
        first = len(text) - len(text.lstrip())
        found = [c for c in self.candidates(text) if first < c[0] < last]
        found.append((last, 20.0, len(text)))
        n = len(found)
        depth = self._depths(text, [f[0] for f in found], first)
        openings = [1.0] + [self._open_score(text, f) for f in found[:-1]]
        best = [-math.inf] * (n + 1)
        back = [0] * (n + 1)
        best[0] = 0.0
        starts = [first] + [f[2] for f in found]
        top_opening = max(openings)
        reach = [0.0] * (n + 1)  # the best chain that ends at a candidate or before
        for j in range(1, n + 1):
            end, mark, _ = found[j - 1]
            for i in range(j - 1, -1, -1):
                # no span from here or before can win any more, as spans only get longer
                if reach[i] + SPAN_BASE + top_opening + mark - max(0, end - starts[i] - LONG_SPAN) / LONG_SPAN <= best[j]:
                    break
                span = self.span(text, starts[i], end) + openings[i] + mark
                # a quotation or bracket opened in the span must close in it
                span -= 5.0 * abs(depth[j] - depth[i])
                if best[i] + span > best[j]:
                    best[j], back[j] = best[i] + span, i
                if i and found[i - 1][1] >= 11.0:
                    break  # nothing reaches across a blank line
            reach[j] = max(reach[j - 1], best[j])
        out = []
        j = n
        while j:
            out.append(found[j - 1][0])
            j = back[j]
        return out[::-1]

    def _open_score(self, text: str, found: tuple[int, float, int]) -> float:
        if found[1] >= 5.0 and "\n" in text[found[0] : found[2]]:
            return 0.0
        if _THAI.match(text[found[2]]):
            return 0.0  # the blank's own score has it
        key = opening_key(text, found[2])
        # names stand at the start of sentences and inside: a capital, or a word seen at starts, weighs at least this
        low = -1.0 if key[:1].isupper() or self.start.get(key, 0) >= 2 else -5.0
        return max(low, self.opening(key))

    def _depths(self, text: str, ends: list[int], first: int) -> list[int]:
        """Open brackets and quotations at each candidate, counted from the start of its paragraph."""
        out, stack, at, straight = [0], [], first, 0
        for end in ends:
            for m in _BRACKETS.finditer(text, at, end):
                at, c = m.start(), m[0]
                if c == '"':
                    straight ^= 1
                elif stack and c in PAIRS.get(stack[-1], ""):
                    stack.pop()
                elif c in PAIRS and c != "‘":
                    stack.append(c)
                elif c == "\n" and text[at + 1 : at + 2] == "\n":
                    stack, straight = [], 0
            at = max(at, end)
            out.append(len(stack) + straight)
        return out

    def span(self, text: str, start: int, end: int) -> float:
        """Length and shape of a whole span: bare enumerators, lone marks and very long spans are unlikely."""
        piece = text[start:end]
        size = len(piece)
        score = SPAN_BASE
        if size < 60 and is_enumerator(piece):
            score -= 14.0
        elif size < 4 and not _CJK.search(piece) and not re.search("[가-힣]", piece):
            score -= 4.0
        if size > LONG_SPAN:
            score -= (size - LONG_SPAN) / LONG_SPAN
        return score


def _split(model: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(model)
        for pdf in batches:
            yield pdf[["id"]].assign(ends=[splitter.ends(t) for t in pdf["text"]])

    return run


def sentence_ends(items: DataFrame, item_id: str = "item_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """(item_id, sent_end) for every sentence of every item.

    Null and blank texts have no row. Repeated rows of one item give its ends once each. Texts are taken whole whatever their
    length, and a span may leave out any number of candidates. Columns other than the two are ignored.
    """
    ship_package(items.sparkSession)
    model = model or boundary_model(items, text)
    id_type = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInPandas(_split(model), f"id {id_type}, ends array<int>")
    return found.select(F.col("id").alias(item_id), F.explode("ends").alias("sent_end")).distinct()


def sentences(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, sent_no, sentence): the ordered sentences of each item, blanks between them left out."""
    ship_package(items.sparkSession)
    model = boundary_model(items, text)
    id_type = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(model)
        for pdf in batches:
            out = []
            for key, t in zip(pdf["id"], pdf["text"]):
                at = 0
                for no, end in enumerate(splitter.ends(t), 1):
                    out.append((key, no, t[at:end].strip()))
                    at = end
            yield pd.DataFrame(out, columns=["id", "sent_no", "sentence"])

    return rows.mapInPandas(run, f"id {id_type}, sent_no int, sentence string").withColumnRenamed("id", item_id)
