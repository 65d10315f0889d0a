"""Sources and sinks: text matrices, delimited tables, metadata, model files, seeded synthetic data."""
