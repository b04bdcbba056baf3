"""PySpark engine for collecting, merging and querying posts that carry links."""
