"""Column-level building blocks: fixed tables, blank rule, techniques, fakes."""
