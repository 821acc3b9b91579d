"""The registered queries: inputs derived from the given tables, and the SQL each result is checked against."""
