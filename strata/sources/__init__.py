"""Where rows come from and go to: read-only parquet folders, versioned tables, exports."""
