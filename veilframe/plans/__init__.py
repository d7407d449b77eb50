"""End-to-end jobs, derived fixtures and the registered query catalogue."""
