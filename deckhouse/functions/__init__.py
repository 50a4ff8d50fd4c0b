"""Column expressions and the few functions that need bytes or XML trees."""
