"""metrum: analytics over time-aligned sequences, written for Spark's DataFrame API."""
