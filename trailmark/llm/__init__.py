"""Training-data operators over a ``documents(doc_id, text, ...)`` table."""
