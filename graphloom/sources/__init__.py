"""Sources and sinks of triples."""
