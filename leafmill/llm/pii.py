"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Fixed patterns find e-mail addresses, IP addresses, card and telephone numbers: the protected entities.
An entity is what its spellings have in common: digits of a number, an address without leading zeros, an
e-mail in lower case.  The corpus then tells which other terms give an entity c away.  A term t near c (``context`` code points
to either side) discloses PMI(c; t) / IC(c) of it, where IC(c) = log N / n(c) and PMI(c; t) =
log N n(c, t) / (n(c) n(t)): 1 for a term that never occurs without the entity, 0 for an independent one.
Terms at ``generalise`` or above are found wherever they occur and replaced by their class, at ``remove``
or above by nothing.  Counts are of documents, copies included: who searches the corpus for the term finds
them all.  Only pairs in at least ``min_support`` documents count, as a pair seen once tells nothing, and only
those whose log-likelihood ratio (G) is significant at ``alpha`` when all pairs of the
corpus are tested (Bonferroni), so that chance companions do not count, however many pairs there are.

Counts cover all documents.  Terms that disclose are broadcast while they are few
(``max_broadcast``) and shuffled beyond that; so are the documents' spans.

Defined results: a null or empty text has no spans; spans of different kinds may overlap, a term's span
does not overlap a pattern's; every row is a document of its own, copies and null ids too; an empty table gives an empty result; columns of the input named like a result column are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, hidden, with_place

SPAN = "struct<kind:string,start:long,end:long>"
#: Kinds of the fixed patterns, in their order; ``term`` follows.
KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers keep Java's matcher from trying the same characters again.  A match that could
# start inside a run could start at its first character or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Zeros alone, or any zeros before a number from 1 to 255.
_BYTE = "(?:0++(?![0-9])|0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
LETTER = r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class PiiParams:
    context: int = 60
    min_length: int = 3
    min_support: int = 2
    alpha: float = 0.01
    generalise: float = 0.90
    remove: float = 0.98
    #: Terms, or spans and terms of documents, that may be broadcast: a few megabytes.
    max_broadcast: int = 100_000


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def matches(text: Column, pattern: Column, kind: Column) -> Column:
    """array<struct<kind,start,end,value>> of a pattern's matches, leftmost and non-overlapping.

    The pieces between the matches give their places.
    """
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["piece"])
        end = begin + F.length(p["match"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"), p["match"].alias("value"))).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("piece"), found.alias("match")), lambda p: p["match"].isNotNull())
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns by kind as listed, then place, with their values."""
    t, none = F.coalesce(text, F.lit("")), F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    each = []
    for kind in KINDS:
        found = matches(t, F.lit(PATTERNS[kind]), F.lit(kind))
        there = F.contains(t, F.lit(NEEDED[kind])) if NEEDED[kind] else t.rlike(PATTERNS[kind])
        each.append(F.when(there, _only_valid(kind, found)).otherwise(none))
    return F.concat(*each)


def _only_valid(kind: str, found: Column) -> Column:
    return F.filter(found, lambda m: _valid(kind, m["value"]))


def _words(text: Column, min_length: int) -> Column:
    return F.array_distinct(F.filter(F.split(text, rf"[^\p{{L}}\p{{N}}]+"), lambda w: (F.length(w) >= min_length) & ~w.rlike("^[0-9]+$")))


def entity_of(kind: Column, value: Column) -> Column:
    """The entity that a match names, whatever its spelling."""
    number = F.regexp_replace(value, "[^0-9]", "")
    plain = F.when(kind == "email", F.lower(value)).when(kind == "ip", F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")).otherwise(number)
    return F.concat_ws(":", kind, plain)


def _g(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events being independent."""
    f = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return 2 * (f(both) + f(a - both) + f(b - both) + f(n - a - b + both) - f(a) - f(n - a) - f(b) - f(n - b) + f(n))


def disclosing_terms(found: DataFrame, words: DataFrame, n_docs: int, params: PiiParams) -> DataFrame:
    """(term, disclosure) above the lower threshold.  ``found``: place, entity and the text near it."""
    near = found.select("entity", "place", F.explode(_words(F.col("near"), params.min_length)).alias("term"))
    every = cut(near.groupBy("entity", "term").agg(F.countDistinct("place").alias("n_both")))
    pairs = every.filter(F.col("n_both") >= params.min_support)
    critical = NormalDist().inv_cdf(1 - params.alpha / max(1, every.count()) / 2) ** 2
    entities = found.groupBy("entity").agg(F.countDistinct("place").alias("n_entity"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term"))
    n, real = F.lit(float(n_docs)), lambda c: F.col(c).cast("double")
    ic = F.log2(n / F.col("n_entity"))
    pmi = F.log2(n * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_term")))
    scored = pairs.join(entities, "entity").join(terms, "term").filter(_g(real("n_both"), real("n_entity"), real("n_term"), n) >= critical)
    return scored.select("term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure")).groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= params.generalise)


def _small(df: DataFrame, params: PiiParams, elements: Column | None = None) -> DataFrame:
    """``df``, to be broadcast if it is small; ``elements`` counts what a row holds."""
    total = df.agg(F.sum(F.lit(1) if elements is None else elements)).first()[0] or 0
    return F.broadcast(df) if total <= params.max_broadcast else df


def find_personal_data(docs: DataFrame, params: PiiParams = PiiParams(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``terms``: spans of the patterns, and of the terms that give them away with their disclosure."""
    inside, kept, names = hidden(docs, "base", "terms")
    placed = with_place(inside).withColumn("_text", F.coalesce(F.col(names[text_col]), F.lit("")))
    spans = cut(placed.select("_place", base_spans(F.col("_text")).alias("base"), "_text").withColumn("around", F.transform("base", lambda s: F.concat_ws(" ", F.substring(F.col("_text"), F.greatest(F.lit(1), s["start"] - params.context + 1).cast("int"), F.least(s["start"], F.lit(params.context)).cast("int")), F.substring(F.col("_text"), (s["end"] + 1).cast("int"), F.lit(params.context))))).drop("_text").filter(F.size("base") > 0))
    found = spans.select(F.col("_place").alias("place"), F.explode(F.arrays_zip("base", "around")).alias("s")).select("place", entity_of(F.col("s.base.kind"), F.col("s.base.value")).alias("entity"), F.col("s.around").alias("near"))
    words = placed.select("_place", F.explode(_words(F.col("_text"), params.min_length)).alias("term"))
    flagged = cut(disclosing_terms(found, words, docs.count(), params))
    holding = cut(words.join(_small(flagged, params), "term").groupBy("_place").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_scores")))
    # Base spans and terms of a document, by its place.
    extra = spans.select("_place", F.col("base").alias("_base")).join(holding, "_place", "full")
    pattern = F.concat(F.lit(rf"(?<!{LETTER})(?:"), F.array_join(F.map_keys("_scores"), "|"), F.lit(rf")(?!{LETTER})"))
    base = F.coalesce(F.col("_base"), F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>"))
    hits = F.filter(matches(F.col("_text"), pattern, F.lit("term")), lambda m: ~F.exists(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    terms = F.when(F.col("_scores").isNotNull(), F.transform(hits, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.element_at(F.col("_scores"), m["value"]).alias("disclosure")))).otherwise(F.array())
    held = F.lit(1) + F.coalesce(F.size("_base"), F.lit(0)) + F.coalesce(F.size("_scores"), F.lit(0))
    joined = placed.join(_small(extra, params, held), "_place", "left")
    return joined.select(*kept, base.alias("base"), terms.alias("terms"))


def sanitise(docs: DataFrame, params: PiiParams = PiiParams(), text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind, and disclosing terms generalised or removed."""
    inside, back, names = hidden(docs)
    found, text_col = find_personal_data(inside, params, names[text_col]), names[text_col]
    mark = lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))
    general = lambda s: F.when(s["disclosure"] >= params.remove, "").when(s["value"].rlike(r"[\p{N}]"), "<code>").when(s["value"].rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")
    cuts = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("put"))), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), general(s).alias("put")))))
    text, start = F.col(text_col), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    upto = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))
    step = lambda s, c: F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.concat(s["out"], upto(s["at"], c["start"]), F.when(c["start"] >= s["at"], c["put"]).otherwise("")).alias("out"))
    clean = F.aggregate(cuts, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return found.withColumn(text_col, F.when(text.isNotNull(), clean)).select(*back)
