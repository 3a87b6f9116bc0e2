"""Reading and writing run-partitioned datasets."""
