"""Document analytics on Spark: records from documents, resolved, checked, scored and queried."""
