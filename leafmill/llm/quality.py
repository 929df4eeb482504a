"""Quality rules: how far a document's character classes and common words lie from its language.

For every language the corpus itself gives a reference: the shares of the character classes (Unicode
categories, letters by script) and of the words that make up at least ``min_share`` of the language's words.  A document is rejected
when the Jensen-Shannon distance of either histogram to the reference exceeds a threshold.  Guards:
a histogram is compared only from a minimum length on, and a language is a reference only if it has
a minimum of words; a document of any other language is compared with nothing.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
language of its own; repeated rows are judged row by row; an empty table gives an empty result.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE_WORD, bounded_batches

#: Letters are classed by script, Latin ones by case; the other classes are Unicode categories.
SCRIPTS = {
    "latin": ((0x80, 0x24F), (0x300, 0x36F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x77F), (0x8A0, 0x8FF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xEFF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "sign", *list(SCRIPTS)[1:], "letter")
SYMBOLS = "#*$%&|<>"
SCORE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A word is common if it makes up this share of its language's words: 1 / min_share words at most.
    min_share: float = 0.002
    #: References of languages with this share of all documents travel with the tasks, 1 / hot_language_share at most; others are joined.
    hot_language_share: float = 0.001
    min_language_words: int = 2_000
    #: Minimum-length guards, in code points and in words.
    min_chars_compared: int = 200
    min_words_compared: int = 100
    max_js_chars: float = 0.30
    max_js_words: float = 0.37


@dataclass(frozen=True)
class Reference:
    """Per language: shares of the character classes, and of the common words.

    ``rest`` has those of the languages that are not ``hot`` as rows of _lang and ``REST``.
    """

    chars: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    hot: tuple = ()
    rest: DataFrame | None = None


REST = ("_words", "_shares", "_chars")


def class_of(c: int) -> int:
    """Number of a code point's class in ``CLASSES``."""
    if c < 128:
        s = chr(c)
        return 0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 3 if s in "\t\n\v\f\r " else 4 if s in ".,;:!?'\"()-" else 5 if 32 < c < 127 else 6
    kind = unicodedata.category(chr(c))
    if kind[0] in "LM":
        script = next((name for name, ranges in SCRIPTS.items() if any(a <= c <= z for a, z in ranges)), "letter")
        return CLASSES.index(script) if script != "latin" else 1 if kind == "Lu" else 0
    return CLASSES.index({"N": "digit", "Z": "space", "P": "stop", "S": "sign"}.get(kind[0], "control"))


@lru_cache(1)
def _table() -> np.ndarray:
    """Class of every code point; categories are looked up block by block as texts need them."""
    return np.full(0x110000, 255, np.uint8)


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    classes = table[points]
    if (classes == 255).any():
        for block in np.unique(points[classes == 255] >> 8).tolist():
            table[block << 8 : (block + 1) << 8] = [class_of(c) for c in range(block << 8, (block + 1) << 8)]
        classes = table[points]
    return np.bincount(classes, minlength=len(CLASSES))


def js_distance(p: dict, q: dict) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two distributions."""
    seen, total = 0.0, 0.0
    for k, a in p.items():
        if a > 0:
            b = q.get(k, 0.0)
            m = (a + b) / 2
            total += a / 2 * math.log2(a / m) + (b / 2 * math.log2(b / m) if b > 0 else 0.0)
            seen += b
    return math.sqrt(max(0.0, total + (sum(q.values()) - seen) / 2))


def language_reference(docs: DataFrame, params: QualityParams = QualityParams(), text_col: str = "text", lang_col: str = "lang") -> Reference:
    """Statistics of all documents.  What reaches the driver is bounded by the shares of hot languages and common words."""
    bounded_batches(docs.sparkSession)
    lang, all_classes = _language(lang_col), range(len(CLASSES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_docs = docs.count()
    some = docs.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).filter(F.col("n") >= params.hot_language_share * n_docs).collect()
    hot = [r["lang"] for r in some]

    @F.pandas_udf("array<long>")
    def histogram(texts: pd.Series) -> pd.Series:
        return pd.Series([char_histogram(t).tolist() for t in texts])

    def common_words(rows: DataFrame, hint) -> DataFrame:
        word = F.explode(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"))
        counts = rows.select(lang.alias("lang"), word.alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
        big = counts.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= params.min_language_words)
        return counts.join(hint(big), "lang").filter(F.col("n") >= params.min_share * F.col("total"))

    def classes(rows: DataFrame) -> DataFrame:
        h = rows.select(lang.alias("lang"), histogram(text).alias("h"))
        return h.groupBy("lang").agg(*[F.sum(F.col("h")[i]).alias(f"c{i}") for i in all_classes])

    words: dict = {}
    # As many rows as hot languages at most.
    for r in common_words(docs.filter(lang.isin(hot)), F.broadcast).collect():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"] / r["total"]
    for shares in words.values():
        shares[None] = max(0.0, 1.0 - sum(shares.values()))
    chars = {r["lang"]: {i: r[f"c{i}"] / max(1, sum(r[f"c{j}"] for j in all_classes)) for i in all_classes} for r in classes(docs.filter(lang.isin(list(words)))).collect()} if words else {}
    if sum(r["n"] for r in some) == n_docs:
        return Reference(chars, words, tuple(hot))
    others = docs.filter(~lang.isin(hot))
    of_words = common_words(others, lambda df: df).groupBy("lang").agg(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))).alias("w"))
    total = F.greatest(F.lit(1), sum((F.col(f"c{i}") for i in all_classes[1:]), F.col("c0")))
    of_chars = classes(others).select("lang", F.array(*[F.col(f"c{i}") / total for i in all_classes]).alias("_chars"))
    rest = of_words.join(of_chars, "lang").select(F.col("lang").alias("_lang"), F.col("w.word").alias("_words"), F.col("w.share").alias("_shares"), "_chars")
    return Reference(chars, words, tuple(hot), rest)


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def _of_rows(langs: pd.Series, rest: tuple[pd.Series, ...], ref: Reference) -> Reference:
    """The reference of a batch: ``ref``, or what was joined to the rows."""
    if not rest:
        return ref
    chars: dict = {}
    words: dict = {}
    for lang, names, shares, classes in zip(langs, *rest):
        key = lang if isinstance(lang, str) else ""
        if names is not None and key not in words:
            words[key] = dict(zip(names, map(float, shares)))
            words[key][None] = max(0.0, 1.0 - sum(words[key].values()))
            chars[key] = dict(enumerate(map(float, classes)))
    return Reference(chars, words)


def _apply(docs: DataFrame, ref: Reference, lang_col: str, f: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``f`` of the rows of hot languages, and of the others beside their languages' references (named ``REST``)."""
    if ref.rest is None:
        return f(docs, ())
    hot = _language(lang_col).isin(list(ref.hot))
    others = docs.filter(~hot).withColumn("_lang", _language(lang_col)).join(ref.rest, "_lang", "left")
    return f(docs.filter(hot), ()).unionByName(f(others, REST))


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count, hit = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(lines) - len(set(lines))


def judge(text: str | None, lang: str | None, ref: Reference, params: QualityParams) -> tuple:
    text = text if isinstance(text, str) else ""
    words = SPACE_WORD.findall(text)
    n, repeats = len(words), repeat_words(words)
    failed = n < params.min_words or 100 * repeats > params.max_repeat_percent * n
    key = lang if isinstance(lang, str) else ""
    js_chars = js_words = None
    if len(text) >= params.min_chars_compared and key in ref.chars:
        h = char_histogram(text)
        js_chars = js_distance(dict(enumerate((h / max(1, h.sum())).tolist())), ref.chars[key])
    if n >= params.min_words_compared and key in ref.words:
        shares, p = ref.words[key], Counter()
        for w, k in Counter(SPACE_WORD.findall(text.lower())).items():
            p[w if w in shares else None] += k
        total = sum(p.values())
        js_words = js_distance({w: k / total for w, k in p.items()}, shares)
    bad = (js_chars or 0.0) > params.max_js_chars or (js_words or 0.0) > params.max_js_words
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, not (failed or bad), js_chars, js_words


def quality_scores(docs: DataFrame, params: QualityParams = QualityParams(), text_col: str = "text", lang_col: str = "lang", reference: Reference | None = None) -> DataFrame:
    """``docs`` with the counts, both distances and the verdict ``kept`` of each row."""
    ref = language_reference(docs, params, text_col, lang_col) if reference is None else reference
    names = [x.split()[0] for x in SCORE_SCHEMA.split(", ")]

    @F.pandas_udf(SCORE_SCHEMA)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, langs, *rest in batches:
            of_rows = _of_rows(langs, tuple(rest), ref_here)
            rows = [judge(t, g, of_rows, params) for t, g in zip(texts, langs)]
            yield pd.DataFrame(rows, columns=names).astype({"js_chars": "float64", "js_words": "float64", "base_failed": bool, "kept": bool})

    ref_here = Reference(ref.chars, ref.words)
    kept = [c for c in docs.columns if c not in names]
    scored = lambda rows, rest: rows.select(*kept, score(F.col(text_col), F.col(lang_col).cast("string"), *rest).alias("_q"))
    return _apply(docs, ref, lang_col, scored).select(*kept, "_q.*")


def quality_filter(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    ref = language_reference(docs, params)
    ref_here = Reference(ref.chars, ref.words)

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, langs, *rest in batches:
            of_rows = _of_rows(langs, tuple(rest), ref_here)
            yield pd.Series([judge(t, g, of_rows, params)[6] for t, g in zip(texts, langs)], dtype=bool)

    passing = lambda rows, rest: rows.filter(keep(F.col("text"), F.col("lang").cast("string"), *rest)).select(*docs.columns)
    return _apply(docs, ref, "lang", passing)
