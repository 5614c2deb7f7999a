"""mycelia: connected-component analytics on Spark."""
