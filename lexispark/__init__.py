"""lexispark: text-catalogue analytics on the PySpark DataFrame, SQL and streaming APIs."""
