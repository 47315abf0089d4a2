"""Statistical analysis of retail sales as lazy PySpark plans."""
