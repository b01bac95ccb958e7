"""Company names taken apart: legal form, line of business, core; romanised where the script allows it.

Shared by the matching of sources (problem 2) and of aliases (problem 7). What is generic in names (the words for lines of
business, their abbreviations, their counterparts in other scripts, the sounds of Chinese characters) is learned from counts
over all names; only closed tables of scripts and legal forms are fixed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Legal forms and listing notes at the end (or start) of names, lower case without points.
LEGAL = frozenset(
    "inc incorporated corp corporation co company ltd limited plc llc lp llp sa nv bv ag se kgaa gmbh kk k.k oyj ab asa spa srl pty pte bhd tbk holdings holding group grp gp adr ads gdr pfd pref preferred preference sponsored unsponsored "
    "ordinary shares share shs ord class cl reg registered public the a b c st listed formerly".split()
)
LEGAL_CJK = ("股份有限责任公司", "股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "集团", "株式会社", "有限会社", "合同会社", "㈱", "(株)", "주식회사", "㈜", "(주)", "유한회사")
PLACEHOLDERS = frozenset("n/a na none null test tbd unknown - -- . ? x xx xxx nan nil company name".split()) | {"不明", "未知", "없음", "なし", "?"}
# Traditional forms of characters that occur in company names.
TRADITIONAL = str.maketrans(
    "機聯導銘啟澤豐視眾嵐潤農龍萬電東陸潔誠遠聯寧維鵬業銳團責貿軟藥醫療華雲廣國際興發達實環貝車輛鐵鋼鋁銅礦燈運輸資產創億偉慶樂榮鑫飛馬鳥魚風優傳術設備進鑽寶貴賓賀賽紅綠藍紡織縣長門開關陽陰隊際險難雙離靈順須頭題類顯頂顧飾餐館驗騰黃齊亞壓營燒勞勝動華蘭蘇術補製襄見規親觀計訊記許訂評詢話該語說請諸調談論識譯議護讚讓",
    "机联导铭启泽丰视众岚润农龙万电东陆洁诚远联宁维鹏业锐团责贸软药医疗华云广国际兴发达实环贝车辆铁钢铝铜矿灯运输资产创亿伟庆乐荣鑫飞马鸟鱼风优传术设备进钻宝贵宾贺赛红绿蓝纺织县长门开关阳阴队际险难双离灵顺须头题类显顶顾饰餐馆验腾黄齐亚压营烧劳胜动华兰苏术补制襄见规亲观计讯记许订评询话该语说请诸调谈论识译议护赞让",
)
# Revised Romanization of Korean letters and Hepburn spelling of the kana rows.
HANGUL_INITIAL = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
HANGUL_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
HANGUL_FINAL = "- k k ks n nj nh t l lk lm lp ls lt lp lh m p ps t t ng t t k t p t".split()
KANA_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ",
    "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ",
}
KANA = {c: row + v for row, cs in KANA_ROWS.items() for c, v in zip(cs, "aiueo")} | {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu"}
SMALL_KANA = {"ャ": "ya", "ュ": "yu", "ョ": "yo"}
PINYIN_INITIALS = ("zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "z", "c", "s", "y", "w", "")
PINYIN_FINALS = "iang iong uang ang eng ing ong ian iao uai uan ai an ao ei en er ia ie in iu ou ua ue ui un uo ve a e i o u v".split()

_HAN = re.compile(r"[㐀-䶿一-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_HANGUL = re.compile(r"[가-힣]")
_LATIN = re.compile(r"[A-Za-z]")

MIN_SUPPORT = 0.002  # share of all names that a phrase of business must end
ENDING_SUPPORT = 0.0005  # share of all pairs of scripts that a native ending must have


def plain(text: str) -> str:
    """Compatible forms, hiragana as katakana, traditional characters simplified (unless kana stand beside them), accents dropped."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)
    if not _KANA.search(text):
        text = text.translate(TRADITIONAL)
    out = []
    for c in text:
        if c.isascii() or _HAN.match(c) or _KANA.match(c) or _HANGUL.match(c):
            out.append(c)
        else:
            out.append("".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))
    return re.sub(r"\s+", " ", "".join(out)).strip()


def romanise(text: str) -> str:
    """Kana and Hangul by sound; other characters unchanged."""
    out = ""
    for c in text:
        if _HANGUL.match(c):
            n = ord(c) - 0xAC00
            out += "".join(x.replace("-", "") for x in (HANGUL_INITIAL[n // 588], HANGUL_VOWEL[n % 588 // 28], HANGUL_FINAL[n % 28]))
        elif c in SMALL_KANA and out:
            out = re.sub(r"i$", "", out) + (SMALL_KANA[c][1:] if out.endswith(("shi", "chi", "ji")) else SMALL_KANA[c])
        elif c in KANA:
            out += KANA[c]
        elif c in "ッー・":
            continue
        else:
            out += c
    return out


def spread(words: list[str], n: int) -> tuple[str, ...] | None:
    """A reading of words as ``n`` pinyin syllables together, word by word; two to a word where that fits."""
    if not words:
        return () if n == 0 else None
    for k in sorted(range(1, n + 1), key=lambda k: (k != 2, k)):
        head = syllables(words[0], k)
        rest = spread(words[1:], n - k) if head else None
        if rest is not None:
            return (*head, *rest)
    return None


@lru_cache(maxsize=65536)
def syllables(latin: str, n: int) -> tuple[str, ...] | None:
    """A reading of a Latin string as exactly ``n`` pinyin syllables, or none."""
    if n == 0:
        return () if not latin else None
    for initial in PINYIN_INITIALS:
        if not latin.startswith(initial):
            continue
        for final in PINYIN_FINALS:
            cut = len(initial) + len(final)
            if latin.startswith(final, len(initial)):
                rest = syllables(latin[cut:], n - 1)
                if rest is not None:
                    return (latin[:cut], *rest)
    return None


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a clipped or vowel-poor form of ``word``: same first letter, letters in order, maybe one plural s."""
    if short == word:
        return True
    if not short or not word or short[0] != word[0] or len(short) >= len(word):
        return len(short) > 4 and _near(short, word)
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return len(short) > 4 and _near(short, word)
    return len(short) >= 2


def _near(a: str, b: str) -> bool:
    """Within one insertion, deletion, substitution or swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def strip_legal(tokens: list[str]) -> tuple[list[str], list[str]]:
    """Tokens without legal forms and listing notes at the end, and what was taken off."""
    kept, gone = list(tokens), []
    while len(kept) > 1 and kept[-1].rstrip(".").replace(".", "") in LEGAL:
        gone.append(kept.pop().rstrip("."))
    while len(kept) > 1 and kept[0] in ("the", "*st", "st"):
        gone.append(kept.pop(0))
    return kept, gone


def latin_tokens(text: str) -> list[str]:
    """Lower-case tokens; inner capitals part words, an inverted name ("Materials, Pabre Gofo") is turned back, asides are dropped."""
    text = re.sub(r"\((?:formerly|listed|ordinary|pref|sponsored|in )[^)]*\)", " ", text, flags=re.I)
    text = re.sub(r"^\*?ST\s*(?=[A-Z가-힣一-鿿])", "", text) if re.match(r"^\*", text) else text
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"\bint'l\b", "international", text, flags=re.I)
    m = re.match(r"^([^,]+),\s*([^,]+)$", text)
    if m and not all(t.rstrip(".").lower() in LEGAL for t in re.split(r"[\s.]+", m[2].strip()) if t):
        text = f"{m[2]} {m[1]}"
    text = re.sub(r"\s-\s.*$", "", text)
    return [t.strip("'") for t in re.findall(r"[a-z0-9*][a-z0-9'.]*", text.lower().replace("k.k.", "kk").replace("s.a.", "sa").replace("&", " ").replace(" and ", " ")) if t.strip(".'")]


def split_scripts(text: str) -> list[str]:
    """The names in a text: a Latin and a native spelling given together are two."""
    m = re.match(r"^\s*(.+?)\s*[/／|]\s*(.+?)\s*$", text) or re.match(r"^\s*(.+?)\s*[(（]\s*(.+?)\s*[)）]\s*$", text)
    if m:
        a, b = m[1], m[2]
        native = [bool(_HAN.search(x) or _KANA.search(x) or _HANGUL.search(x)) for x in (a, b)]
        if native[0] != native[1] and len(a) > 2 and len(b) > 2:
            return [a, b]
    return [text]


def native_parts(text: str) -> str:
    """A native name without legal forms, blanks and marks."""
    for form in LEGAL_CJK:
        text = text.replace(form, "")
    return re.sub(r"[\s·・.,()（）*\-A-Za-z]+", "", re.sub(r"^\*?ST", "", text))


class Lexicon:
    """Learned tables: phrases of business, native endings with their phrase, sounds of characters."""

    def __init__(self, phrases: list[str], endings: dict[str, str], sounds: dict[str, str]):
        self.phrases, self.endings, self.sounds = phrases, endings, sounds
        self.words = [tuple(p.split()) for p in phrases]
        self.first: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for w in self.words:
            self.first[w[0][0]].append(w)
        self.known = {x for w in self.words for x in w}

    @lru_cache(maxsize=100_000)  # noqa: B019 - lives as long as its worker's batch
    def business(self, tail: tuple[str, ...]) -> str | None:
        """The phrase that these tokens spell or abbreviate, perhaps leaving out its last words."""
        best = None
        for words in self.first.get(tail[0][0], []):
            if len(tail) <= len(words) and all(abbreviates(t.rstrip("."), w) for t, w in zip(tail, words)):
                exact = sum(t == w for t, w in zip(tail, words))
                opens = sum(w.startswith(t.rstrip(".")) for t, w in zip(tail, words))
                rank = (exact, opens, len(tail) == len(words), sum(len(t) for t in tail), " ".join(words))
                if best is None or rank > best:
                    best = rank
        return best[4] if best else None

    def latin(self, text: str) -> tuple[list[str], str | None, list[str]]:
        """(core tokens, phrase of business or none, legal forms)."""
        tokens, legal = strip_legal(latin_tokens(text))
        if tokens and tokens[-1] == "industries" and len(tokens) > 2:
            probe = self.business(tuple(tokens[-2:]))
            if probe is None and any(self.business(tuple(tokens[-k - 1 : -1])) for k in (1, 2) if len(tokens) > k + 1):
                legal.append(tokens.pop())
        if tokens and tokens[-1].rstrip(".") in ("intl", "international", "int") and any(self.business(tuple(tokens[-k - 1 : -1])) for k in (1, 2) if len(tokens) > k + 1):
            legal.append(tokens.pop())
        for k in (3, 2, 1):
            if len(tokens) > k:
                found = self.business(tuple(tokens[-k:]))
                short = all(len(t.rstrip(".")) < 3 for t in tokens[-k:])
                if found and not (short and k == 1 and not tokens[-1].endswith(".")):
                    return [t.rstrip(".") if len(t) > 3 else t for t in tokens[:-k]], found, legal
        return tokens, None, legal

    def native(self, text: str) -> tuple[str, str | None, str]:
        """(core by sound, phrase of business or none, core as written)."""
        body = native_parts(text)
        found = None
        for k in range(min(6, len(body) - 1), 0, -1):
            if body[-k:] in self.endings:
                found = self.endings[body[-k:]]
                body = body[:-k]
                break
        if _HAN.search(body):
            heard = [self.sounds.get(c, "?" + c) if _HAN.match(c) else romanise(c) for c in body]
            return "".join(heard), found, body
        return romanise(body), found, body

    def readings(self, text: str | None) -> list[dict]:
        """The names that a text spells, each with core, words, business, legal forms and initial; empty for placeholders."""
        if text is None or plain(text).strip(" .").lower() in PLACEHOLDERS or len(plain(text)) < 2:
            return []
        out = []
        for part in split_scripts(plain(text)):
            native = bool(_HAN.search(part) or _KANA.search(part) or _HANGUL.search(part))
            if native:
                core, business, raw = self.native(part)
                words, legal = [core], []
            else:
                words, business, legal = self.latin(part)
                core, raw = "".join(w.rstrip(".") for w in words), ""
            if not core:
                continue
            initial = not native and len(words) > 1 and words[0].endswith(".") and len(words[0]) <= 4
            out.append({"core": core, "words": [w.rstrip(".") for w in words], "business": business, "legal": " ".join(legal[::-1]), "initial": initial, "native": native, "raw": raw})
        return out


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of what ends names: (kind, a, b, n) with kind one (last word), two (last two words), link (both scripts together)."""
    for pdf in batches:
        c: Counter = Counter()
        for text in pdf["text"]:
            if not text:
                continue
            parts = split_scripts(plain(text))
            latin = [p for p in parts if not (_HAN.search(p) or _KANA.search(p) or _HANGUL.search(p))]
            native = [p for p in parts if p not in latin]
            for p in latin:
                tokens, _ = strip_legal(latin_tokens(p))
                if any(t.endswith(".") for t in tokens):
                    continue  # points mark abbreviations; whole words teach
                if len(tokens) > 1 and len(tokens[-1]) > 3:
                    c["one", tokens[-1], ""] += 1
                if len(tokens) > 2 and len(tokens[-1]) > 3 and len(tokens[-2]) > 3:
                    c["two", tokens[-2], tokens[-1]] += 1
            if latin and native:
                c["link", latin[0], native[0]] += 1
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "a", "b", "n"])


def learn_lexicon(names: DataFrame) -> Lexicon:
    """A lexicon from all names in column ``text``. Every name is counted.

    The learned tables are bounded whatever the number of names: at most 1 / ``MIN_SUPPORT`` last words and twice that many phrases can
    have their share, at most 6 / ``ENDING_SUPPORT`` endings theirs (six lengths of one name), and a script has so many characters.
    """
    counted = names.select("text").mapInPandas(_tails, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).persist()
    total = counted.where(F.col("kind") == "one").agg(F.sum("n")).first()[0] or 0
    least = max(3, int(total * MIN_SUPPORT))
    ends = counted.where((F.col("kind") != "link") & (F.col("n") >= least)).orderBy(F.desc("n"), "a", "b").collect()
    one = {r["a"]: r["n"] for r in ends if r["kind"] == "one"}
    two = [(r["a"], r["b"], r["n"]) for r in ends if r["kind"] == "two"]
    phrases = [f"{a} {b}" for a, b, n in two if n >= 0.2 * one.get(b, n) and n >= least]
    paired = Counter()
    for _, b, n in two:
        paired[b] += n
    phrases += [w for w, n in one.items() if paired[w] < 0.5 * n]
    weight = {f"{a} {b}": n for a, b, n in two} | one
    kept: list[str] = []
    for phrase in sorted(set(phrases), key=lambda x: (-weight[x], x)):
        words = phrase.split()
        # a phrase that abbreviates a more usual one is no phrase of its own
        if not any(len(words) <= len(q.split()) and all(abbreviates(a, b) for a, b in zip(words, q.split())) for q in kept):
            kept.append(phrase)
    lexicon = Lexicon(kept, {}, {})
    linked = counted.where(F.col("kind") == "link").select("a", "b", "n")
    learned = linked.mapInPandas(_links(lexicon), "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    best = learned.groupBy("kind", "a").agg(F.max_by("b", F.struct("n", "b")).alias("b"), F.max("n").alias("top"), F.sum("n").alias("n"))
    spelt_twice = counted.where(F.col("kind") == "link").agg(F.sum("n")).first()[0] or 0
    rows = best.where((F.col("top") >= 0.6 * F.col("n")) & ((F.col("kind") == "sound") | (F.col("n") >= max(2, ENDING_SUPPORT * spelt_twice)))).collect()
    endings = {r["a"]: r["b"] for r in rows if r["kind"] == "ending"}
    sounds = {r["a"]: r["b"] for r in rows if r["kind"] == "sound"}
    counted.unpersist()
    return Lexicon(lexicon.phrases, endings, sounds)


def _links(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"]):
                words, business, _ = lexicon.latin(a)
                core, body = "".join(w.rstrip(".") for w in words), native_parts(b)
                if not business or len(body) < 2:
                    continue
                heard = romanise(body)
                if not _HAN.search(body[:1]):
                    # kana or Hangul: the ending is what remains after the characters that sound like the core
                    for k in range(1, len(body)):
                        if romanise(body[:k]) == core:
                            c["ending", body[k:], business] += n
                elif heard:
                    stems = [w.rstrip(".") for w in words]
                    fits = [k for k in range(2, min(7, len(body))) if spread(stems, len(body) - k)]
                    even = [k for k in fits if len(body) - k == 2 * len(stems)]
                    for k in even or fits:
                        read = spread(stems, len(body) - k)
                        if read and all(_HAN.match(x) for x in body[:-k]):
                            c["ending", body[-k:], business] += n
                            for x, s in zip(body[:-k], read):
                                c["sound", x, s] += n
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "a", "b", "n"])

    return run
