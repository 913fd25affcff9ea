"""Column-level helpers: bands, guarded arithmetic, deterministic hashing, exact ranks."""
