"""Plans: registered queries (catalog), their DuckDB oracles, and end-to-end runs."""
