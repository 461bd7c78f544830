"""Sources and sinks: the raw loan CSV, the derived loan view over the test
tables, and model persistence."""
