"""End-to-end job over raw files, and the queries registered for checking."""
