"""Column functions: geometry, time, statistics, predicates."""
