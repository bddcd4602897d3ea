"""Column functions: text, time, severity, roads, load, geometry, scores, and parsers of external payloads."""
