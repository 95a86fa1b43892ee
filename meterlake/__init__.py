"""Usage analytics on Spark: sources, merge operators, measurement semantics and a catalogue of queries."""
