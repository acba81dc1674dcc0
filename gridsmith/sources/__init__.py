"""Reading and writing files: Parquet, CSV, JSON lines and Excel, and Parquet footers."""
