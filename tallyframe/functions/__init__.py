"""Column-level functions: scalars, name cleaning and NULL-exact aggregates."""
