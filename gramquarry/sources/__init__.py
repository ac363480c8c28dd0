"""Tables as (doc_id, column, value) sources."""
