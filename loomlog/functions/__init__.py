"""Column expressions and the few small per-row helpers."""
