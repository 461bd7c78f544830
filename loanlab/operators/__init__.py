"""DataFrame operators: profiling, exploration, evaluation, splitting,
feature preparation and validation."""
