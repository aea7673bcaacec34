"""File connectors: scans and sinks of the engine's logical tables."""
