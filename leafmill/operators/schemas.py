"""Types of the nested record, the single source for every operator."""

from __future__ import annotations

FIELD = "struct<value:string,confidence:double,evidence:string,page:int,bbox:array<double>>"
CELL = "struct<value:string,confidence:double,evidence:string,page:int,bbox:array<double>,source_evidence:string>"
WORD = "struct<text:string,bbox:array<double>,page:int,confidence:double>"
PAGE = f"struct<page_num:int,text:string,words:array<{WORD}>>"
LINE = f"struct<description:{FIELD},quantity:{FIELD},unit_price:{FIELD},total:{FIELD}>"
RICH_LINE = f"struct<description:{CELL},quantity:{CELL},unit_price:{CELL},total:{CELL},row_type:string,math_valid:boolean,page:int,table_index:int>"
ERROR = "struct<stage:string,message:string,detail:string,fatal:boolean>"
RESULT = "struct<rule_name:string,status:string,message:string,confidence_impact:double,suggested_fix:string>"

#: The 14 scalar fields of an extracted invoice.
FIELDS = (
    "invoice_number",
    "invoice_date",
    "due_date",
    "vendor_name",
    "vendor_address",
    "vendor_tax_id",
    "buyer_name",
    "buyer_address",
    "subtotal",
    "tax_amount",
    "total_amount",
    "currency",
    "payment_terms",
    "purchase_order",
)
#: Those that become rows of the long form.
STORED_FIELDS = ("invoice_number", "invoice_date", "due_date", "buyer_name", "subtotal", "tax_amount", "total_amount", "currency", "payment_terms", "purchase_order")
MANDATORY = ("invoice_number", "vendor_name", "invoice_date", "total_amount", "currency")
ROW_TYPES = ("item", "discount", "tax", "subtotal", "total", "shipping", "header", "unknown")
EXTRACTED = "struct<" + ",".join(f"{f}:{FIELD}" for f in FIELDS) + f",line_items:array<{LINE}>,rich_line_items:array<{RICH_LINE}>>"
LOW_CONFIDENCE = 0.75
