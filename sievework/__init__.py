"""Literature-screening analytics on Spark."""
