"""Where tables come from: catalogs, Parquet folders and CSV files."""
