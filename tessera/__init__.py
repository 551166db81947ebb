"""Profile, advise on and rewrite the physical layout of Parquet data with Spark."""
