"""Column expressions and small driver-side mathematics."""
