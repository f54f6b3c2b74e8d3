"""Column functions: all native expressions, no Python code per row."""
