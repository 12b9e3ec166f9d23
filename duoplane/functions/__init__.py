"""Column-level functions: value encoding, comparisons, literals."""
