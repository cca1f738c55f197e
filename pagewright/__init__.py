"""pagewright: web-content and lead analytics expressed as Spark columns and DataFrame transforms."""
