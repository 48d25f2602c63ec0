"""Reading and writing: Parquet, JSON lines, snapshot tables, registry."""
