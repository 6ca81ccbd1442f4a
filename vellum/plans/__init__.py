"""Relations derived from the driver's tables, and composed plans."""
