"""State changes as pure transforms: each takes tables and returns their next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.schemas import LOW_CONFIDENCE, STORED_FIELDS

#: Tables of a tenant, children first.
PURGE_ORDER = ("invoice_fields", "line_items", "invoices", "audit_log", "reviewer_feedback", "vendor_templates", "vendors", "export_history", "documents", "batches", "workspaces")
#: Tables that carry the tenant themselves and move with it.
TENANT_TABLES = ("documents", "vendors", "vendor_templates", "invoices", "audit_log", "reviewer_feedback", "batches", "export_history")


BATCH = ["workspace_id", "batch_id"]


def document_status(errors: Column, needs_review: Column) -> Column:
    """A fatal error fails the document, else a review is pending, else it is complete."""
    return F.when(F.exists(errors, lambda e: e["fatal"]), "failed").when(F.coalesce(needs_review, F.lit(False)), "needs_review").otherwise("complete")


def upsert_documents(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """New documents join; known ones get the type, status and errors of the incoming row only."""
    new = incoming.select("id", F.struct(*[c for c in incoming.columns if c != "id"]).alias("n"))
    both = documents.withColumn("_old", F.lit(True)).join(new, "id", "full")
    out = []
    for c in documents.columns:
        if c == "id":
            out.append(F.col("id"))
        elif c in ("document_type", "status", "errors"):
            out.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*out)


def replace_rows(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of the incoming keys are deleted and inserted anew."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upsert_vectors(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """One vector for each (workspace_id, vendor_id): the incoming one where there is one, of several the last by ``ord``."""
    key = ["workspace_id", "vendor_id"]
    last = incoming.filter("embedding is not null").groupBy(*key).agg(F.max_by("embedding", "ord").alias("embedding"))
    return vectors.select(*key, "embedding").join(last.select(*key), key, "left_anti").unionByName(last)


def export_entries(exported: DataFrame, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Entries of the export history for ``exported`` (export_id, workspace_id, created_at, one row an invoice):
    kind, filters, number of invoices and name of the file of each export."""
    used = {k: v for k, v in (filters or {}).items() if v is not None}
    params = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(used.items()) for x in kv])) if used else F.lit("{}")
    counted = exported.groupBy("export_id", "workspace_id", "created_at").agg(F.count("*").alias("record_count"))
    name = F.concat(F.lit("invoices_export_"), F.date_format("created_at", "yyyyMMdd_HHmmss"), F.lit(".xlsx"))
    return counted.select("export_id", "workspace_id", F.lit("filtered" if used else "all").alias("export_type"), params.alias("filter_params"), "record_count", name.alias("filename"), "created_at")


def unpivot_fields(invoices: DataFrame) -> DataFrame:
    """The stored fields of ``extracted`` in long form."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"extracted.{f}").alias("f")) for f in STORED_FIELDS])
    rows = invoices.select(F.col("id").alias("invoice_id"), F.col("needs_review").alias("_review"), F.explode(each).alias("x"))
    conf = F.coalesce(F.col("x.f.confidence"), F.lit(0.0))
    return rows.select("invoice_id", "x.field_name", F.col("x.f.value").alias("raw_value"), conf.cast("decimal(4,3)").alias("confidence"), F.col("x.f.evidence").alias("evidence"), F.col("x.f.page").alias("page"), F.col("x.f.bbox").alias("bbox"), (conf < LOW_CONFIDENCE).alias("needs_review"), (~F.col("_review")).alias("reviewed"), F.lit(None).cast("string").alias("reviewed_value"))


def explode_lines(invoices: DataFrame) -> DataFrame:
    """One row for each line of ``items``, with its position."""
    rows = invoices.select(F.col("id").alias("invoice_id"), F.posexplode("items").alias("position", "i"))
    raw = [F.col(f"i.{k}.value").alias(f"{k}_raw") for k in ("description", "quantity", "unit_price", "total")]
    conf = [F.col(f"i.{k}.confidence").cast("decimal(4,3)").alias(f"{k}_confidence") for k in ("description", "quantity", "unit_price", "total")]
    return rows.select("invoice_id", "position", *raw, *conf, "i.row_type", "i.math_valid", "i.page", "i.table_index")


def audit_rows(rows: DataFrame, stage: str, action: str, document_col: str = "document_id", after: Column | None = None, extra: Column | None = None) -> DataFrame:
    """Audit entries for ``rows``."""
    none = F.lit(None).cast("string")
    return rows.select("workspace_id", F.col(document_col).alias("document_id"), F.lit("system").alias("actor"), F.lit(stage).alias("stage"), F.lit(action).alias("action"), (none if after is None else F.sha2(after, 256)).alias("after_hash"), (none if extra is None else extra.cast("string")).alias("extra"))


def approve(invoices: DataFrame, fields: DataFrame, documents: DataFrame, ids: list) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Invoices ``ids`` pass review: (invoices, fields, documents, audit)."""
    hit = F.col("id").isin(*ids)
    done = invoices.filter(hit)
    docs = documents.join(done.select(F.col("document_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    return (
        invoices.withColumn("needs_review", F.when(hit, False).otherwise(F.col("needs_review"))),
        fields.withColumn("reviewed", F.when(F.col("invoice_id").isin(*ids), True).otherwise(F.col("reviewed"))),
        docs.withColumn("status", F.when(F.col("_hit"), "complete").otherwise(F.col("status"))).drop("_hit"),
        audit_rows(done, "review", "approved"),
    )


def reject(invoices: DataFrame, documents: DataFrame, ids: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices ``ids`` are turned down: their documents fail."""
    hit = F.col("id").isin(*ids)
    gone = invoices.filter(hit)
    docs = documents.join(gone.select(F.col("document_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    return (
        invoices.withColumn("needs_review", F.when(hit, False).otherwise(F.col("needs_review"))),
        docs.withColumn("status", F.when(F.col("_hit"), "failed").otherwise(F.col("status"))).drop("_hit"),
        audit_rows(gone, "review", "rejected"),
    )


def correct_fields(fields: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, feedback): corrections (invoice_id, field_name, value, reason) set the reviewed value; a real change gives feedback."""
    both = fields.join(corrections.select("invoice_id", "field_name", F.col("value").alias("_v"), F.col("reason").alias("_r")), ["invoice_id", "field_name"], "left")
    changed = F.col("_v").isNotNull()
    out = both.withColumns({"reviewed_value": F.when(changed, F.col("_v")).otherwise(F.col("reviewed_value")), "reviewed": F.when(changed, True).otherwise(F.col("reviewed"))})
    feedback = both.filter(changed & ~F.col("_v").eqNullSafe(F.col("raw_value"))).select("invoice_id", F.col("field_name").alias("field_type"), F.col("raw_value").alias("original_value"), F.col("_v").alias("corrected_value"), "confidence", F.col("_r").alias("reason"))
    return out.select(*fields.columns), feedback


def update_vendors(vendors: DataFrame, changes: DataFrame) -> DataFrame:
    """Given values of name, aliases and status replace the old ones."""
    c = changes.select("vendor_id", *[F.col(x).alias(f"_{x}") for x in ("canonical_name", "aliases", "status")])
    out = vendors.join(c, "vendor_id", "left")
    return out.withColumns({x: F.coalesce(f"_{x}", x) for x in ("canonical_name", "aliases", "status")}).select(*vendors.columns)


def purge(tables: dict[str, DataFrame], workspaces: DataFrame) -> dict[str, DataFrame]:
    """All rows of the workspaces (``workspace_id``) go, children first."""
    gone = workspaces.select("workspace_id").distinct()
    out = dict(tables)
    for name in PURGE_ORDER:
        if name not in tables:
            continue
        if name in ("invoice_fields", "line_items"):
            owned = tables["invoices"].join(gone, "workspace_id", "left_semi").select(F.col("id").alias("invoice_id"))
            out[name] = tables[name].join(owned, "invoice_id", "left_anti")
        elif name == "workspaces":
            out[name] = tables[name].join(gone.withColumnRenamed("workspace_id", "id"), "id", "left_anti")
        else:
            out[name] = tables[name].join(gone, "workspace_id", "left_anti")
    return out


def migrate(tables: dict[str, DataFrame], guest: str, owner: str) -> dict[str, DataFrame]:
    """A guest's rows become the owner's; the guest goes."""
    if guest == owner:
        raise ValueError("a workspace cannot move to itself")
    out = {n: t.withColumn("workspace_id", F.when(F.col("workspace_id") == guest, owner).otherwise(F.col("workspace_id"))) if n in TENANT_TABLES else t for n, t in tables.items()}
    if "workspaces" in out:
        out["workspaces"] = out["workspaces"].filter(F.col("id") != guest)
    return out


def expired(workspaces: DataFrame, now: Column | None = None) -> DataFrame:
    """Guests past their time."""
    return workspaces.filter((F.col("workspace_type") == "guest") & F.col("expires_at").isNotNull() & (F.col("expires_at") < (F.current_timestamp() if now is None else now)))


def admit(requests: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with ``admitted``, uses left): in arrival order a workspace gets as many as it has uses left."""
    w = Window.partitionBy("workspace_id").orderBy("arrival", "request_id")
    ranked = requests.withColumn("_n", F.row_number().over(w)).join(uses, "workspace_id", "left")
    out = ranked.withColumn("admitted", F.col("_n") <= F.coalesce(F.col("uses_left"), F.lit(0)))
    asked = requests.groupBy("workspace_id").agg(F.count("*").alias("_asked"))
    left = uses.join(asked, "workspace_id", "left").withColumn("uses_left", F.greatest(F.lit(0), F.col("uses_left") - F.coalesce(F.col("_asked"), F.lit(0)))).drop("_asked")
    return out.drop("_n", "uses_left"), left


def batch_counters(documents: DataFrame, batches: DataFrame) -> DataFrame:
    """Completed, failed, skipped and pending of each batch, and its mean confidence."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias(s[0])
    done = documents.groupBy(*BATCH).agg(n("complete", "needs_review"), n("failed"), n("skipped"), F.avg("confidence").cast("decimal(4,3)").alias("avg_confidence"))
    out = batches.join(done, BATCH, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("complete", "failed", "skipped")})
    return out.withColumnRenamed("complete", "completed").withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("failed") - F.col("skipped")))


def retry_counters(batches: DataFrame, retried: DataFrame) -> DataFrame:
    """``retried``: (workspace_id, batch_id, ok) of documents tried again."""
    ok = retried.groupBy(*BATCH).agg(F.count_if("ok").alias("_ok"))
    out = batches.join(ok, BATCH, "left").withColumn("_ok", F.coalesce("_ok", F.lit(0)))
    return out.withColumns({"completed": F.col("completed") + F.col("_ok"), "failed": F.greatest(F.lit(0), F.col("failed") - F.col("_ok"))}).drop("_ok")


def set_archived(batches: DataFrame, ids: list, archived: bool, now: Column | None = None) -> DataFrame:
    hit = F.col("batch_id").isin(*ids)
    at = (F.current_timestamp() if now is None else now) if archived else F.lit(None).cast("timestamp")
    return batches.withColumns({"is_archived": F.when(hit, archived).otherwise(F.col("is_archived")), "archived_at": F.when(hit, at).otherwise(F.col("archived_at"))})


def rename_batch(batches: DataFrame, batch_id, name: str) -> DataFrame:
    return batches.withColumn("name", F.when(F.col("batch_id") == batch_id, name).otherwise(F.col("name")))


def duplicate_batch(batches: DataFrame, batch_id, new_id) -> DataFrame:
    """A copy with the name and source only."""
    copy = batches.filter(F.col("batch_id") == batch_id).select(*[F.lit(new_id).cast(t).alias(c) if c == "batch_id" else F.concat(F.col(c), F.lit(" (Copy)")).alias(c) if c == "name" else F.col(c) if c in ("workspace_id", "upload_source") else F.lit(False).alias(c) if c == "is_archived" else F.lit(0).cast(t).alias(c) if t in ("int", "bigint") else F.lit(None).cast(t).alias(c) for c, t in batches.dtypes])
    return batches.unionByName(copy)


def delete_batches(batches: DataFrame, documents: DataFrame, ids: list) -> tuple[DataFrame, DataFrame]:
    """(batches, documents): archived ones of ``ids`` go, their documents lose the batch; others stay."""
    gone = batches.filter(F.col("batch_id").isin(*ids) & F.col("is_archived")).select("batch_id")
    docs = documents.join(gone.withColumn("_gone", F.lit(True)), "batch_id", "left").withColumn("batch_id", F.when(F.col("_gone"), None).otherwise(F.col("batch_id"))).drop("_gone")
    return batches.join(gone, "batch_id", "left_anti"), docs.select(*documents.columns)
