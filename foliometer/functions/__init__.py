"""Column expressions: no function in this package triggers a job."""
