"""Sources and sinks: parquet test tables, bank views over them, text and
document readers, mapping/rule/lineage writers."""
