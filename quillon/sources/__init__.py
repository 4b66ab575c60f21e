"""CSV and Parquet sources."""
