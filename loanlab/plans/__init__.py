"""Query plans: the registered queries (one per operator of the inventory),
their DuckDB oracle statements, and the end-to-end workflows."""
