"""SQL twins of the derived views and scalar functions, as DuckDB runs them."""

from __future__ import annotations

AMOUNT_TEXT = """CASE {id} % 4 WHEN 0 THEN CAST({x} AS VARCHAR) WHEN 1 THEN '$' || {g} WHEN 2 THEN translate({g}, ',.', '.,') ELSE translate({g}, ',.', ' ,') END"""


def grouped(x: str) -> str:
    """An amount with two decimals and commas at thousands."""
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE format('{{:,.2f}}', CAST({x} AS DECIMAL(18,2))::DOUBLE) END)"


def amount_text(x: str, id_: str = "id") -> str:
    d = f"CAST({x} AS DECIMAL(18,2))"
    return AMOUNT_TEXT.format(id=id_, x=d, g=grouped(x))


_KEPT = "regexp_replace({v}, '[^0-9.,-]', '', 'g')"


def parse_amount(v: str) -> str:
    s = _KEPT.format(v=v)
    comma, dot = f"instr(reverse({s}), ',')", f"instr(reverse({s}), '.')"
    parts = f"string_split(replace({s}, ',', '.'), '.')"
    thousands = f"(len({parts}) > 2 OR (length({parts}[-1]) = 3 AND length({parts}[1]) <= 3 AND regexp_replace({parts}[1], '^-+', '') <> ''))"
    text = f"""CASE WHEN {comma} > 0 AND {dot} > 0 AND {comma} < {dot} THEN replace(replace({s}, '.', ''), ',', '.')
 WHEN {comma} > 0 AND {dot} > 0 THEN replace({s}, ',', '')
 WHEN {comma} > 0 OR {dot} > 0 THEN CASE WHEN {thousands} THEN replace(replace({s}, ',', ''), '.', '') ELSE replace({s}, ',', '.') END ELSE {s} END"""
    return f"TRY_CAST(({text}) AS DECIMAL(38,10))"


def parse_decimal(v: str) -> str:
    s = _KEPT.format(v=v)
    text = f"""CASE WHEN regexp_matches({s}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]+)?$') THEN replace(replace({s}, '.', ''), ',', '.')
 WHEN contains({s}, ',') AND NOT contains({s}, '.') THEN replace({s}, ',', '.')
 WHEN contains({s}, ',') AND contains({s}, '.') THEN replace({s}, ',', '') ELSE {s} END"""
    return f"TRY_CAST(({text}) AS DECIMAL(38,10))"


#: Common table expressions: inv, docs, vend, bat, lin and rec.
VIEWS = f"""
sums AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(6,4)))) AS DECIMAL(18,4)) AS subtotal,
  CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(6,4))) AS DECIMAL(20,6)) * CAST(l_tax AS DECIMAL(6,4))) AS DECIMAL(18,4)) AS tax_amount, min(l_suppkey) AS vendor_id, count(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey),
inv AS MATERIALIZED (SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS document_id, 'ws' || n_regionkey AS workspace_id, o_orderkey % 20 AS batch_id, vendor_id, s_name AS vendor_name, 'INV-' || (o_orderkey % 5000) AS invoice_number,
  strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
  strftime(CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) - 1 ELSE CAST(o_orderdate AS DATE) + 30 END, '%Y-%m-%d') AS due_date,
  c_name AS buyer_name, subtotal, tax_amount, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,4)) END AS DECIMAL(18,4)) AS total_amount,
  CASE WHEN o_orderkey % 17 = 0 THEN '$' WHEN o_orderkey % 5 = 0 THEN 'EUR' WHEN o_orderkey % 5 = 1 THEN 'GBP' ELSE 'USD' END AS currency,
  CASE o_orderkey % 6 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'Due on  Receipt' WHEN 2 THEN 'cash' WHEN 3 THEN '45 days' END AS payment_terms,
  CASE WHEN o_orderkey % 3 = 0 THEN 'PO-' || o_orderkey END AS purchase_order, o_orderstatus = 'P' AS needs_review, o_orderdate AS created_at, coalesce(n_lines, 0) AS n_lines,
  CAST(CAST((o_orderkey % 101 * 37) % 101 AS DECIMAL(7,3)) / 100 AS DECIMAL(4,3)) AS overall, o_orderstatus AS order_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sums ON o_orderkey = l_orderkey LEFT JOIN supplier ON vendor_id = s_suppkey),
docs AS MATERIALIZED (SELECT document_id AS id, workspace_id, 'scan_' || id || '.pdf' AS filename, batch_id, CASE WHEN inv.id % 50 = 0 THEN 'processing' WHEN order_status = 'F' THEN 'complete' WHEN order_status = 'P' THEN 'needs_review' ELSE 'failed' END AS status,
  CASE inv.id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'email' ELSE 'text_pdf' END AS document_type, inv.id * 10 % 9973 AS file_size_bytes, created_at FROM inv),
vend AS MATERIALIZED (SELECT s_suppkey AS vendor_id, 'ws' || n_regionkey AS workspace_id, s_name AS canonical_name, CASE WHEN s_suppkey % 4 = 0 THEN 'pending_review' ELSE 'active' END AS status,
  lpad(CAST(s_suppkey % 90 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS tax_id, n_name AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bat AS MATERIALIZED (SELECT workspace_id, batch_id, 'Batch ' || batch_id AS name, batch_id % 5 = 0 AS is_archived, 'web' AS upload_source, count(*) AS total, min(created_at) AS created_at FROM docs GROUP BY workspace_id, batch_id),
lin0 AS MATERIALIZED (SELECT *, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey),
lin AS MATERIALIZED (SELECT l_orderkey AS invoice_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN 'Discount 10%' WHEN l_partkey % 13 = 0 THEN 'TVA 20%' WHEN l_partkey % 17 = 0 THEN 'Sub total' WHEN l_partkey % 19 = 0 THEN 'Grand Total'
  WHEN l_partkey % 23 = 0 THEN 'Shipping and handling' WHEN l_partkey % 29 = 0 THEN 'Continued from page 1' ELSE p_type || ' ' || p_name END AS description,
  CAST(q AS VARCHAR) AS quantity, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS unit_price,
  CAST(CASE WHEN l_orderkey % 9 = 0 THEN CAST(ext + 7 AS DECIMAL(18,2)) WHEN l_orderkey % 10 = 0 THEN NULL ELSE ext END AS VARCHAR) AS total, l_extendedprice FROM lin0),
rec0 AS MATERIALIZED (SELECT *, CASE WHEN id % 31 = 0 THEN NULL ELSE invoice_number END AS v_number, CASE WHEN id % 37 = 0 THEN 'soon' ELSE invoice_date END AS v_date, CASE WHEN id % 41 = 0 THEN '12-34' WHEN id % 43 = 0 THEN 'X' ELSE vendor_name END AS v_vendor,
  {amount_text("subtotal")} AS v_sub, CASE WHEN id % 29 = 0 THEN 'n/a' WHEN id % 23 = 0 THEN '-' || ({amount_text("tax_amount")}) ELSE {amount_text("tax_amount")} END AS v_tax,
  CASE WHEN id % 10 < 3 THEN {amount_text("CAST(subtotal + tax_amount AS DECIMAL(18,4))")} ELSE {amount_text("total_amount")} END AS v_total FROM inv),
rec AS MATERIALIZED (SELECT *, {parse_amount("v_sub")} AS sub, {parse_amount("v_tax")} AS tax, {parse_amount("v_total")} AS tot, TRY_CAST(v_date AS DATE) AS day, TRY_CAST(due_date AS DATE) AS due, id % 3 <> 1 AND vendor_name IS NOT NULL AS vendor_matched,
  concat_ws(' ', 'Invoice', v_number, 'of', v_date, CASE WHEN id % 8 <> 0 THEN v_vendor END, buyer_name, CASE WHEN id % 9 <> 0 THEN v_total END, v_sub, currency, payment_terms) AS raw_text FROM rec0)
"""

#: Position, name and SQL value of each of the 14 fields.
FIELD_VALUES = tuple(enumerate(
    (("invoice_number", "v_number"), ("invoice_date", "v_date"), ("due_date", "due_date"), ("vendor_name", "v_vendor"), ("vendor_address", "NULL"), ("vendor_tax_id", "CASE WHEN id % 2 = 0 THEN '12-3456789' END"), ("buyer_name", "buyer_name"), ("buyer_address", "' '"), ("subtotal", "v_sub"), ("tax_amount", "v_tax"), ("total_amount", "v_total"), ("currency", "currency"), ("payment_terms", "payment_terms"), ("purchase_order", "purchase_order"))
))


def confidence(k: int, value: str) -> str:
    return f"(CASE WHEN ({value}) IS NULL THEN 0.0::DOUBLE ELSE ((id * {k + 3}) % 100)::DOUBLE / 100 END)"


def with_views(select: str) -> str:
    return f"WITH {VIEWS} {select}"
