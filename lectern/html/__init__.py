"""HTML in pure Python: tree, snapshot, blocks; wrapped for Spark in udfs."""
