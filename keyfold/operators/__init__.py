"""DataFrame operators over mutation logs, runs and the run catalogue."""
