"""Scale building blocks: numbering, exact ranks, skew-safe joins, written stages."""
