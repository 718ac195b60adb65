"""Entity alignment on Spark: reference terms against a linked-data graph. See README.md."""
