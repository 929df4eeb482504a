"""Scalar functions on text fields: currencies, dates, tax ids, row types, terms, keys and JSON."""

from __future__ import annotations

import html as html_lib
import re
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.plan import bound

# Fixed values, which results depend on.
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₺": "TRY", "₽": "RUB", "R$": "BRL", "A$": "AUD", "C$": "CAD", "HK$": "HKD", "S$": "SGD"}
KNOWN_CURRENCIES = "USD EUR GBP JPY CNY INR AUD CAD CHF HKD SGD SEK NOK DKK MXN BRL RUB ZAR NZD AED THB IDR PLN CZK HUF ILS CLP PKR PHP MYR".split()
ISO_4217 = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC
CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK
JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN
NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN
SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL
""".split()
ROW_PATTERNS = (
    ("total", r"grand\s+total|total\s+due|total\s+amount|montant\s+total|total\s+ttc|gesamt(betrag)?|total\s+a\s+pagar"),
    ("subtotal", r"sub\s*total|total\s+ht|net\s+amount|zwischensumme|montant\s+ht|before\s+tax"),
    ("tax", r"tax|tva|vat|mwst|iva|gst|hst|sales\s+tax|taxe|impuesto"),
    ("discount", r"discount|remise|rabais|rabatt|descuento|sconto|reduction|less\b"),
    ("shipping", r"shipping|freight|delivery|transport|port|envío|livraison|frais\s+de\s+port|handling"),
    ("header", r"continued|suite|continued\s+from|page\s+\d+"),
)
TERMS_PATTERNS = (r"net\s*\d+", r"due\s+on\s+receipt", "cod", "cia", "prepaid", r"\d+\s*days?", r"\d+/\d+\s*net\s*\d+", "eom", r"upon\s+completion", "immediate")
#: Read in this order; a date that fits two formats is the first's.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd", "dd-MM-yyyy")
EU_VAT = "AT BE BG CY CZ DE DK EE EL ES FI FR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK".split()


def blank(value: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")) == "", F.lit(True))


def normalize_currency(value: Column) -> Column:
    """ISO code of a currency symbol or of any three letters; else null."""
    v = F.trim(value)
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(symbols, v), F.when(F.length(v) == 3, F.upper(v)))


def is_known_currency(value: Column) -> Column:
    return F.upper(F.trim(value)).isin(*KNOWN_CURRENCIES)


def is_iso_4217(value: Column) -> Column:
    return F.upper(F.trim(value)).isin(*ISO_4217)


def parse_date(value: Column) -> Column:
    """The first format that fits; null if none does."""
    return bound(F.trim(value), lambda v: F.coalesce(*[F.try_to_date(v, f) for f in DATE_FORMATS]))


def validate_tax_id(value: Column) -> Column:
    """A US number as NN-NNNNNNN, an EU one without separators, anything else trimmed."""
    v = F.trim(value)
    digits, compact = F.regexp_replace(v, "[^0-9]", ""), F.upper(F.regexp_replace(v, r"[\s.\-]", ""))
    us = v.rlike(r"^[0-9]{2}-?[0-9]{7}$") & ~F.substring(digits, 1, 2).isin("00", "07", "08", "09", "17", "18", "19", "28", "29", "49", "69", "70", "78", "79", "89", "96", "97")
    eu = compact.rlike(rf"^({'|'.join(EU_VAT)})[0-9A-Z]{{8,12}}$") & compact.rlike("[0-9]{2}")
    return F.when(us, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7))).when(eu, compact).otherwise(v)


def classify_row_type(description: Column) -> Column:
    """Kind of an invoice row by its description: the first pattern that matches, else an item."""
    some = "|".join(pattern for _, pattern in ROW_PATTERNS)
    out = F.when(F.coalesce(description, F.lit("")) == "", "unknown")
    # Most rows are items: one search tells them, not one for each kind.  Of ASCII alone the flag U asks for nothing else.
    ascii_only = F.octet_length(description) == F.length(description)
    out = out.when(ascii_only & ~description.rlike(rf"(?i)\b(?=\w)(?:{some})\b"), "item")
    for kind, pattern in ROW_PATTERNS:
        out = out.when(description.rlike(rf"(?iU)\b({pattern})\b"), kind)
    return out.otherwise("item")


def is_payment_terms(value: Column) -> Column:
    return value.rlike("(?i)" + "|".join(TERMS_PATTERNS))


def normalize_terms(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def ground_key(value: Column) -> Column:
    """Without white space, case folded."""
    return F.replace(F.lower(F.regexp_replace(value, r"(?U)\s+", "")), F.lit("ß"), F.lit("ss"))


def quoted(value: Column) -> Column:
    """In single quotes, or in double ones if the text holds a single one only."""
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    q = F.when(single & ~double, F.lit('"')).otherwise(F.lit("'"))
    body = F.when(single & double, F.replace(value, F.lit("'"), F.lit("\\'"))).otherwise(value)
    return F.coalesce(F.concat(q, body, q), F.lit("None"))


_CLOSED_REFERENCE = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _unescape_closed(text: str) -> str:
    known = lambda m: m[1][0] == "#" or f"{m[1]};" in html5
    return _CLOSED_REFERENCE.sub(lambda m: html_lib.unescape(m[0]) if known(m) else m[0], text)


def strip_tags(html: Column, closed_only: bool = False) -> Column:
    """Tags become spaces and character references, named or numeric, the characters of HTML 5.

    HTML 5 reads some names without their semicolon as well; with ``closed_only`` such text stays as it is.
    """
    decode = _unescape_closed if closed_only else html_lib.unescape

    @F.pandas_udf("string")
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(decode, na_action="ignore")

    text = F.regexp_replace(html, "<[^>]+>", " ")
    return F.when(F.contains(text, F.lit("&")), unescaped(text)).otherwise(text)


def fenced_json(answer: Column) -> Column:
    """What a fenced block of an answer holds, or the whole answer."""
    inside = F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.when(answer.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), inside).otherwise(answer)


FIELD_JSON = "value string, confidence double, evidence string, page int, bbox array<double>"


def coerce_field(json: Column, name: str) -> Column:
    """A field of an answer as a struct: a bare value gets confidence 1, a missing or null one 0."""

    def field(raw: Column) -> Column:
        return bound(F.from_json(raw, FIELD_JSON), lambda full: with_full(raw, full))

    def with_full(raw: Column, full: Column) -> Column:
        is_object = F.coalesce(F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False))
        value = F.when(is_object, full["value"]).otherwise(raw)
        confidence = F.when(raw.isNull(), 0.0).when(is_object, F.coalesce(full["confidence"], F.lit(0.0))).otherwise(1.0)
        return F.struct(value.alias("value"), confidence.alias("confidence"), full["evidence"].alias("evidence"), full["page"].alias("page"), full["bbox"].alias("bbox"))

    return bound(F.get_json_object(json, f"$.{name}"), field)


def canonical_json(record: Column) -> Column:
    """JSON with the struct's own field order; give fields alphabetically for a stable hash."""
    return F.to_json(record)


def llm_cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    """Cost of a call; an unknown model costs nothing.  Rates a thousand tokens are fixed values."""
    rates = {"gpt-4o-mini": (0.00015, 0.00060), "gpt-4o": (0.00250, 0.01000), "gpt-4-turbo": (0.01000, 0.03000)}
    out = reduce(lambda w, kv: w.when(model == kv[0], tokens_in / 1000 * kv[1][0] + tokens_out / 1000 * kv[1][1]), rates.items(), F)
    return out.otherwise(0.0)


def provider_error(status: Column, kind: Column, message: Column) -> Column:
    """A short text for a provider's error."""
    low = F.lower(message)
    return (
        F.when(status == 401, "Invalid API key")
        .when(status == 404, "Model not found")
        .when(status == 429, F.when(F.contains(low, F.lit("quota")), "Quota exceeded").otherwise("Rate limited"))
        .when(F.contains(F.lower(kind), F.lit("timeout")) | F.contains(low, F.lit("timed out")), "Network timeout")
        .otherwise(message)
    )


def confidence_bucket(confidence: Column, high: float = 0.90, low: float = 0.75) -> Column:
    return F.when(confidence >= high, "green").when(confidence >= low, "yellow").otherwise("red")


def first_reasons(reasons: Column, n: int = 3) -> Column:
    """The first reasons, and how many more there are."""
    more = F.size(reasons) - n
    return F.concat(F.slice(reasons, 1, n), F.when(more > 0, F.array(F.concat(more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))


def last_of(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), F.lit(n))
