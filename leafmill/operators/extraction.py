"""Field extraction: providers behind one interface, a deterministic reader as the default.

A provider takes a text and returns a JSON answer.  It runs inside tasks, batch by batch; providers are
tried in order, and a row whose last provider fails keeps an error instead of a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.plan import bound, once
from leafmill.functions.text import blank, coerce_field, fenced_json
from leafmill.operators.schemas import FIELDS

Provider = Callable[[str], str]

#: Labels that stand before a value, in several languages. Fixed values.
LABELS = {
    "invoice_number": r"invoice\s*(?:no|number|nr|#)|rechnungsnummer|num[ée]ro\s+de\s+facture|facture\s*n[°o]",
    "invoice_date": r"invoice\s+date|date\s+of\s+issue|rechnungsdatum|date\s+de\s+facture|date",
    "due_date": r"due\s+date|payment\s+due|f[äa]llig(?:\s+am)?|[ée]ch[ée]ance",
    "vendor_name": r"from|vendor|seller|supplier|fournisseur|lieferant",
    "buyer_name": r"bill\s+to|buyer|customer|client|kunde",
    "vendor_tax_id": r"tax\s+id|ein|vat\s+(?:id|no)|ust-?id",
    "subtotal": r"sub\s*total|net\s+amount|total\s+ht|zwischensumme",
    "tax_amount": r"(?:sales\s+)?tax(?:\s+\([^)]*\))?|vat|tva|mwst",
    "total_amount": r"grand\s+total|total\s+due|total\s+amount|total\s+ttc|gesamtbetrag|total",
    "currency": r"currency|devise|w[äa]hrung",
    "payment_terms": r"payment\s+terms|terms|conditions\s+de\s+paiement|zahlungsbedingungen",
    "purchase_order": r"purchase\s+order|po\s*(?:number|no|#)|bestellnummer",
}
_LINE = {k: re.compile(rf"^[ \t]*(?:{v})[ \t]*[:#][ \t]*(.+?)[ \t]*$", re.I | re.M) for k, v in LABELS.items()}


def read_labels(text: str) -> str:
    """Values after known labels, as an answer in JSON; each value is verbatim from the text."""
    out = {}
    for name, pattern in _LINE.items():
        m = pattern.search(text)
        if m:
            out[name] = {"value": m[1], "confidence": 0.9, "evidence": m[0].strip()}
    return json.dumps(out)


def fallback(*providers: Provider) -> Provider:
    """The first provider that answers; the last one's error stands."""

    def ask(text: str) -> str:
        for i, p in enumerate(providers):
            try:
                return p(text)
            except Exception:
                if i == len(providers) - 1:
                    raise
        raise ValueError("no provider")

    return ask


def whole_json(body: Column) -> Column:
    """The JSON object of an answer; of one that is cut off, up to its last whole member; else null."""
    holds = lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")), F.lit(False)) & F.try_parse_json(x).isNotNull()
    closed = lambda x: F.concat(F.regexp_extract(x, r"(?s)^(.*\})[^}]*$", 1), F.lit("}"))
    return bound(body, lambda b: F.when(holds(b), b).otherwise(bound(closed(b), lambda c: F.when(holds(c), c))))


def parse_answers(df: DataFrame, answer: Column, name: str = "extracted") -> DataFrame:
    """``df`` with the record of an answer, whether plain JSON, in a fenced block or cut off at its end; null if it is none of these."""
    read = once(df, {"_body": whole_json(fenced_json(answer))})
    return read.withColumn(name, F.when(F.col("_body").isNotNull(), F.struct(*[coerce_field(F.col("_body"), f).alias(f) for f in FIELDS]))).drop("_body")


def extract(docs: DataFrame, provider: Provider = read_labels) -> DataFrame:
    """Adds ``extracted`` and ``extract_error`` to documents with ``id`` and ``raw_text``; a blank text is not asked about."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for text in b["raw_text"]:
                try:
                    answers.append(provider(text))
                    errors.append(None)
                except Exception as e:  # a row with an error, not a failed job
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"id": b["id"], "answer": answers, "extract_error": errors})

    asked = docs.filter(~blank(F.col("raw_text"))).select("id", "raw_text").mapInPandas(ask, "id string, answer string, extract_error string")
    out = parse_answers(docs.join(asked, "id", "left"), F.col("answer"))
    bad = F.col("answer").isNotNull() & F.col("extracted").isNull()
    return out.withColumn("extract_error", F.when(blank(F.col("raw_text")), "empty text").when(bad, "the answer is not JSON").otherwise(F.col("extract_error"))).drop("answer")
