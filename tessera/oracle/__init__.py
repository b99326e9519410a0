"""ANSI SQL twins of the registered queries, run by DuckDB over the same
parquet tables (the correctness gate). Written from the query semantics, not
from the Spark code, so that a bug in one is not copied into the other."""
