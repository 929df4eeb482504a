"""Vendors: resolve names, remember what their invoices looked like, and use it; layout templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.patterns import IndexParams, least_pattern
from leafmill.functions.plan import cut, numbered, remove_folder, shared_folder
from leafmill.functions.similarity import COSINE_THRESHOLD, FUZZY_THRESHOLD, fuzzy_matches, similar_names, vector_top1
from leafmill.functions.text import blank, normalize_terms, quoted
from leafmill.functions.vectors import with_embedding

# Fixed values.
CURRENCY_BOOST, TERMS_BOOST, HISTORY_BOOST, DUPLICATE_PENALTY = 0.10, 0.08, 0.05, 0.20
HIGH_AVERAGE, LOW_AVERAGE, LOW_COUNT = 0.85, 0.60, 3
ALPHA, MAX_NUMBERS, MAX_PRODUCTS = 0.2, 500, 20


def candidates(vendors: DataFrame) -> DataFrame:
    """(workspace_id, vendor_id, display, position): every name and alias; positions follow vendor and place."""
    names = F.concat(F.array("canonical_name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    each = vendors.select("workspace_id", "vendor_id", F.posexplode(names).alias("_k", "display")).filter("display is not null")
    return each.select("workspace_id", "vendor_id", "display", F.struct("vendor_id", "_k").alias("position"))


def vendor_vectors(vendors: DataFrame) -> DataFrame:
    """(workspace_id, vendor_id, embedding) of every vendor's name."""
    return with_embedding(vendors.select("workspace_id", "vendor_id", "canonical_name"), F.col("canonical_name")).select("workspace_id", "vendor_id", "embedding")


def resolve_vendors(records: DataFrame, vendors: DataFrame, threshold: float = FUZZY_THRESHOLD, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(workspace_id, name, vendor_id, how, score) for each distinct name: ``fuzzy``, ``vector`` or ``new``.

    ``search`` finds the nearest vectors of (workspace_id, query_id, embedding), such as ``indexed_top1`` or ``vector_top1`` with
    vectors of their own; by default all names of vendors are searched exactly.

    A new vendor's id comes from its tenant and name.  New names that match one another share the id of
    the one that arrived first (``arrival``); a blank name resolves to nothing.
    """
    names = records.filter(~blank(F.col("name"))).groupBy("workspace_id", "name").agg(F.min("arrival").alias("arrival"))
    # Each stage is computed once, as what it finds is both a result and left out of the next one.
    fuzzy = cut(fuzzy_matches(names, candidates(vendors), threshold))
    found = fuzzy.select("workspace_id", "name", F.col("vendor_id").cast("string").alias("vendor_id"), F.lit("fuzzy").alias("how"), "score")
    rest = names.join(fuzzy.select("workspace_id", "name"), ["workspace_id", "name"], "left_anti")
    find = search or (lambda asked: vector_top1(asked, vendor_vectors(vendors), COSINE_THRESHOLD))
    near = cut(find(with_embedding(rest, F.col("name")).filter("embedding is not null").select("workspace_id", F.col("name").alias("query_id"), "embedding")))
    near = near.select("workspace_id", F.col("query_id").alias("name"), F.col("vendor_id").cast("string").alias("vendor_id"), F.lit("vector").alias("how"), (F.col("score") * 100).alias("score"))
    found = found.unionByName(near)
    rest = rest.join(near.select("workspace_id", "name"), ["workspace_id", "name"], "left_anti")
    return found.unionByName(lead_new_names(cut(rest), threshold))


def lead_new_names(names: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """New vendors: each name joins the earliest one it matches that leads itself, else it leads.

    All matching names of a tenant meet by ``similar_names``.  Then in rounds: a name with no earlier match
    that leads or is open leads, one with an earlier match that leads follows, and the others stay open.
    """
    at = F.struct("arrival", "name")
    known = names.withColumn("at", at)
    pairs = similar_names(names.select("workspace_id", "name"), names.select("workspace_id", F.col("name").alias("other")), threshold).filter("name <> other")
    both = pairs.join(known.select("workspace_id", "name", "at"), ["workspace_id", "name"]).join(known.select("workspace_id", F.col("name").alias("other"), F.col("at").alias("other_at")), ["workspace_id", "other"])
    earlier = cut(both.filter("other_at < at").select("workspace_id", "name", "other", "other_at"))
    key, state = ["workspace_id", "name"], cut(known.select("workspace_id", "name", F.lit(None).cast("boolean").alias("leads")))
    while True:
        ahead = earlier.join(state.select("workspace_id", F.col("name").alias("other"), F.col("leads").alias("other_leads")), ["workspace_id", "other"])
        seen = ahead.groupBy(*key).agg(F.max(F.coalesce("other_leads", F.lit(False))).alias("led"), F.max(F.col("other_leads").isNull()).alias("waits"))
        turn = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(F.col("waits"), None).otherwise(True)
        state = cut(state.join(seen, key, "left").select(*key, turn.alias("leads")))
        if state.filter("leads is null").isEmpty():
            break
    leaders = state.filter("leads").select("workspace_id", F.col("name").alias("other"))
    own = earlier.join(leaders, ["workspace_id", "other"]).groupBy(*key).agg(F.min_by("other", "other_at").alias("leader"))
    led = state.join(own, key, "left").select(*key, F.when(F.col("leads"), F.col("name")).otherwise(F.col("leader")).alias("leader"))
    return led.select("workspace_id", "name", F.substring(F.sha2(F.concat_ws("|", "workspace_id", "leader"), 256), 1, 32).alias("vendor_id"), F.lit("new").alias("how"), F.lit(None).cast("double").alias("score"))


# Memory.


def three(x: float) -> float:
    """Rounded to three places, half up, of the decimal that the double stands for (to nine places first)."""
    # Decimals cost the most of a fold; only what lies near the middle of two results needs them.
    if 0 <= x < 1e6 and abs((part := x * 1000) - (low := int(part)) - 0.5) > 1e-4:
        return (low + (part - low > 0.5)) / 1000
    return float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP).quantize(Decimal("1e-3"), ROUND_HALF_UP))


MEMORY = "invoice_count int, avg_confidence double, historical_invoice_numbers array<string>, tax_ids array<string>, tax_id string, preferred_currency string, preferred_payment_terms string, rate_line_items double, rate_purchase_order double"
MEMORY_NAMES = [c.split()[0] for c in MEMORY.split(", ")]
EVENT = ("number", "tax_id", "currency", "terms", "confidence", "has_lines", "has_order")
#: A vendor of which nothing is known.
NO_MEMORY = (0, None, [], [], None, None, None, 0.0, 0.0)


def remember(memory: tuple, event: tuple) -> tuple:
    """A vendor's memory after one more invoice; every step rounds to three places, so that the order of the invoices counts.

    Empty strings are no values: they are neither remembered nor preferred.
    """
    n, average, numbers, tax_ids, tax_id, currency, terms, lines, orders = memory
    number, its_tax, its_currency, its_terms, confidence, has_lines, has_order = (None if x is None or x != x or x == "" else x for x in event)
    n += 1
    rate = lambda r, b: three(float(bool(b)) if n <= 1 else (r * (n - 1) + float(bool(b))) / n)
    if confidence is not None:
        average = three(ALPHA * confidence + (1 - ALPHA) * (average or confidence))
    if number is not None and number not in numbers:
        numbers = [*numbers, number][-MAX_NUMBERS:]
    if its_tax is not None and its_tax not in tax_ids:
        tax_ids = [*tax_ids, its_tax]
    first = lambda old, new: new if old is None else old
    return n, average, numbers, tax_ids, first(tax_id, its_tax), first(currency, its_currency), first(terms, its_terms), rate(lines, has_lines), rate(orders, has_order)


def vendor_memory(events: DataFrame) -> DataFrame:
    """Memory of each (workspace_id, vendor_id) from its invoices, ordered by ``ord`` and then by what they hold.

    The steps depend on one another, so a vendor's invoices pass through one task; they come sorted from the
    shuffle and only the memory of the present vendor is held.
    """
    schema = events.select("workspace_id", "vendor_id").schema
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def fold(batches):
        owner, memory = None, NO_MEMORY
        for b in batches:
            out = []
            for workspace, vendor, *event in b.itertuples(index=False):
                if (workspace, vendor) != owner:
                    if owner is not None:
                        out.append((*owner, *memory))
                    owner, memory = (workspace, vendor), NO_MEMORY
                memory = remember(memory, event)
            yield pd.DataFrame(out, columns=["workspace_id", "vendor_id", *MEMORY_NAMES])
        if owner is not None:
            yield pd.DataFrame([(*owner, *memory)], columns=["workspace_id", "vendor_id", *MEMORY_NAMES])

    dealt = events.filter("workspace_id is not null and vendor_id is not null").repartition("workspace_id", "vendor_id").sortWithinPartitions("workspace_id", "vendor_id", "ord", *EVENT)
    folded = dealt.select("workspace_id", "vendor_id", *EVENT).mapInPandas(fold, f"{types}, {MEMORY}")
    return folded.select("workspace_id", "vendor_id", F.struct(*MEMORY_NAMES).alias("memory"))


def vendor_memory_chained(events: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """The same memory as ``vendor_memory``, a vendor's invoices in chunks that pass its memory on from one to the next.

    Every step depends on the one before, so a vendor's chunks follow one another; but a task holds one chunk, the chunks
    of all vendors with the same number run side by side, and what is lost is a chunk and not a vendor.
    """
    spark = events.sparkSession
    folder, key = shared_folder(spark, "memory_chunks"), ["workspace_id", "vendor_id"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*key).schema)
    held = f"struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in MEMORY.split(', '))}>"

    def fold(batches):
        owner, memory = None, NO_MEMORY
        told = lambda: [(*owner, dict(zip(MEMORY_NAMES, memory)))] if owner is not None else []
        for b in batches:
            out = []
            for workspace, vendor, _, before, *event in b.itertuples(index=False):
                if (workspace, vendor) != owner:
                    out += told()
                    owner, memory = (workspace, vendor), NO_MEMORY
                if before is not None:
                    memory = tuple(list(x) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else x for x in (before[c] for c in MEMORY_NAMES))
                else:
                    memory = remember(memory, event)
            yield pd.DataFrame(out, columns=[*key, "memory"])
        yield pd.DataFrame(told(), columns=[*key, "memory"])

    try:
        few = events.filter("workspace_id is not null and vendor_id is not null").select(*key, "ord", *EVENT)
        rows = numbered(few, key, ["ord", *EVENT], f"{folder}/rows").withColumn("chunk", F.floor(F.col("_rank") / chunk_rows))
        rows.write.partitionBy("chunk").parquet(f"{folder}/chunks")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/chunks")
        last = rows.agg(F.max("chunk")).first()[0]
        out = spark.createDataFrame([], f"{types}, memory {held}")
        for chunk in range(0 if last is None else last + 1):
            here = rows.filter(F.col("chunk") == chunk).select(*key, "_rank", F.lit(None).cast(held).alias("memory"), *EVENT)
            go_on = out.join(here.select(*key).distinct(), key, "left_semi").select(*key, F.lit(-1).cast("long").alias("_rank"), "memory", *[F.lit(None).cast(here.schema[c].dataType).alias(c) for c in EVENT])
            folded = here.union(go_on).repartition(*key).sortWithinPartitions(*key, "_rank").mapInPandas(fold, f"{types}, memory {held}")
            folded.write.parquet(f"{folder}/memory_{chunk}")
            new = spark.read.schema(folded.schema).parquet(f"{folder}/memory_{chunk}")
            out = new.unionByName(out.join(new.select(*key), key, "left_anti"))
        return cut(out)
    finally:
        remove_folder(spark, folder)


def key_confidence(extracted: Column) -> Column:
    """Mean confidence of the number, vendor, total and currency of a record."""
    return sum((extracted[f]["confidence"] for f in ("invoice_number", "vendor_name", "total_amount", "currency")), F.lit(0.0)) / 4


def memory_events(records: DataFrame) -> DataFrame:
    """What a vendor's memory takes from ``records`` (workspace_id, vendor_id, ord, extracted, canonicalized)."""
    e, c = F.col("extracted"), F.col("canonicalized")
    lines = F.coalesce(F.size(e["line_items"]), F.lit(0)) + F.coalesce(F.size(e["rich_line_items"]), F.lit(0)) > 0
    order = F.coalesce(e["purchase_order"]["value"] != "", F.lit(False))
    return records.filter("vendor_id is not null").select(
        "workspace_id", "vendor_id", "ord", e["invoice_number"]["value"].alias("number"), e["vendor_tax_id"]["value"].alias("tax_id"), c["currency"].alias("currency"),
        e["payment_terms"]["value"].alias("terms"), key_confidence(e).alias("confidence"), lines.alias("has_lines"), order.alias("has_order"),
    )


def top_products(lines: DataFrame, n: int = MAX_PRODUCTS) -> DataFrame:
    """The most frequent products of each vendor; ties go to the one seen first."""
    counted = lines.groupBy("vendor_id", "product").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("vendor_id").orderBy(F.desc("n"), "first", "product")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def products_fold(products: Column, n: int = MAX_PRODUCTS) -> Column:
    """The order-dependent list: at each step the kept list and the new ones are counted anew."""

    def step(kept: Column, new: Column) -> Column:
        both = F.concat(kept, new)
        distinct = F.array_distinct(both)
        counted = F.transform(distinct, lambda p, i: F.struct((-F.size(F.filter(both, lambda x: x == p))).alias("n"), i.alias("i"), p.alias("p")))
        return F.slice(F.transform(F.array_sort(counted), lambda c: c["p"]), 1, n)

    return F.aggregate(products, F.array().cast("array<string>"), step)


def keep_products(kept: list[str], new: list[str], n: int = MAX_PRODUCTS) -> list[str]:
    """The kept list after one more invoice: the most frequent of both, of equal ones the first."""
    both = [*kept, *new]
    counts = Counter(both)
    return both[:n] if len(counts) == len(both) else sorted(counts, key=counts.get, reverse=True)[:n]


def products_by_order(lines: DataFrame, n: int = MAX_PRODUCTS) -> DataFrame:
    """(vendor_id, products): ``products_fold`` over each vendor's invoices in the order of ``ord``.

    ``lines``: vendor_id, ord, product.  A vendor's lines come sorted from the shuffle; the kept list and one
    invoice's lines are held.
    """
    kind = lines.schema["vendor_id"].dataType.simpleString()

    def fold(batches):
        owner, kept, order, new = None, [], None, []
        settle = lambda: keep_products(kept, new, n)
        for b in batches:
            out = []
            for vendor, at, product in b.itertuples(index=False):
                if vendor != owner or at != order:
                    kept, new, order = settle(), [], at
                    if vendor != owner:
                        if owner is not None:
                            out.append((owner, kept))
                        owner, kept = vendor, []
                new.append(product)
            yield pd.DataFrame(out, columns=["vendor_id", "products"])
        if owner is not None:
            yield pd.DataFrame([(owner, settle())], columns=["vendor_id", "products"])

    dealt = lines.select("vendor_id", "ord", "product").filter("vendor_id is not null and ord is not null and product is not null")
    return dealt.repartition("vendor_id").sortWithinPartitions("vendor_id", "ord", "product").mapInPandas(fold, f"vendor_id {kind}, products array<string>")


def boost(records: DataFrame, vendors: DataFrame) -> DataFrame:
    """Raises or lowers confidences of ``extracted`` by the vendor's memory; adds ``boost_reasons``.

    ``records`` has vendor_id; ``vendors`` has vendor_id, canonical_name, preferred_currency,
    preferred_payment_terms, historical_invoice_numbers, avg_confidence and invoice_count.
    """
    e, m = F.col("extracted"), F.col("_m")
    memory = vendors.select("vendor_id", F.struct("canonical_name", "preferred_currency", "preferred_payment_terms", "historical_invoice_numbers", "avg_confidence", "invoice_count").alias("_m"))
    up = lambda f, d: e[f].withField("confidence", F.least(F.lit(1.0), e[f]["confidence"] + d))
    down = lambda f, d: e[f].withField("confidence", F.greatest(F.lit(0.0), e[f]["confidence"] - d))
    same_currency = F.coalesce(F.upper(e["currency"]["value"]) == F.upper(m["preferred_currency"]), F.lit(False))
    same_terms = F.coalesce(normalize_terms(e["payment_terms"]["value"]) == normalize_terms(m["preferred_payment_terms"]), F.lit(False)) & ~blank(e["payment_terms"]["value"])
    number = e["invoice_number"]["value"]
    seen = F.coalesce(F.array_contains(m["historical_invoice_numbers"], number), F.lit(False)) & (number != "")
    average = m["avg_confidence"].cast("double")
    high, low = F.coalesce(average >= HIGH_AVERAGE, F.lit(False)), F.coalesce((average < LOW_AVERAGE) & (m["invoice_count"] >= LOW_COUNT), F.lit(False))
    name = quoted(m["canonical_name"])
    reasons = F.array_compact(
        F.array(
            F.when(seen, F.concat(F.lit("Invoice number "), quoted(number), F.lit(" seen before for vendor "), name, F.lit(" — possible duplicate"))),
            F.when(low, F.concat(F.lit("Vendor "), name, F.lit(" has historically low extraction confidence ("), F.format_string("%.2f", average), F.lit(") — manual verification recommended"))),
        )
    )
    boosted = (
        e.withField("currency", F.when(same_currency, up("currency", CURRENCY_BOOST)).otherwise(e["currency"]))
        .withField("payment_terms", F.when(same_terms, up("payment_terms", TERMS_BOOST)).otherwise(e["payment_terms"]))
        .withField("invoice_number", F.when(seen, down("invoice_number", DUPLICATE_PENALTY)).otherwise(e["invoice_number"]))
        .withField("vendor_name", F.when(high, up("vendor_name", HISTORY_BOOST)).otherwise(e["vendor_name"]))
    )
    return records.join(memory, "vendor_id", "left").withColumn("boost_reasons", reasons).withColumn("extracted", boosted).drop("_m")


# Templates.


def learn_templates(invoices: DataFrame, templates: DataFrame) -> DataFrame:
    """Version 1 for each vendor without a template that has an invoice past review, from its first one."""
    known = templates.select("workspace_id", "vendor_id").distinct()
    fit = invoices.filter("vendor_id is not null and not needs_review").join(known, ["workspace_id", "vendor_id"], "left_anti")
    first = fit.groupBy("workspace_id", "vendor_id").agg(F.min_by(F.struct("vendor_name", "n_lines"), "id").alias("f"))
    return first.select("workspace_id", "vendor_id", F.lit(1).alias("version"), F.coalesce(F.col("f.vendor_name"), F.lit("Unknown Vendor")).alias("fingerprint"), F.col("f.n_lines").alias("n_lines"), F.lit(True).alias("is_active"))


def latest_templates(templates: DataFrame) -> DataFrame:
    """The highest version of each vendor."""
    w = Window.partitionBy("workspace_id", "vendor_id").orderBy(F.desc("version"))
    return templates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def match_templates(docs: DataFrame, templates: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """Adds ``template_id`` and ``fingerprint``: the active template with the smallest id whose fingerprint the text holds.

    All templates of all tenants are searched for at once (``functions.patterns``); case does not count.
    """
    active = templates.filter("is_active and fingerprint is not null and workspace_id is not null")
    kind = templates.schema["template_id"].dataType.simpleString()
    patterns = active.select(F.col("workspace_id").alias("group"), F.lower("fingerprint").alias("pattern"), F.col("template_id").cast("long").alias("value"), F.col("fingerprint").alias("shown"))
    docs = docs.drop("template_id", "fingerprint")
    found = least_pattern(docs, F.col("workspace_id"), F.lower("raw_text"), patterns, "_h", params)
    return found.select(*[F.col(c) for c in docs.columns], F.col("_h.value").cast(kind).alias("template_id"), F.col("_h.shown").alias("fingerprint"))


def apply_template(raw_text: Column, fingerprint: Column, hints: Column) -> Column:
    """The text with the template's hint lines in front."""
    head = F.concat(F.lit("--- VENDOR TEMPLATE DETECTED: "), fingerprint, F.lit(" ---"))
    return F.when(fingerprint.isNotNull(), F.concat_ws("\n", head, hints, F.lit(""), raw_text)).otherwise(raw_text)
