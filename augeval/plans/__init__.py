"""Role tables over the driver's parquet tables, and the registered query plans."""
