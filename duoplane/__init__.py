"""Two-plane reconciliation on Spark: declared state against discovered state, as DataFrame plans."""
