"""Plan shaping: lineage cuts, salting, ordered blocks."""
