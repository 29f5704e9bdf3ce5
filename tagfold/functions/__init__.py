"""Column functions: lifetimes, durations and sizes, masks, user agents, wire sizes."""
