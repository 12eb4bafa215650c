"""Column builders: no function here starts a job."""
