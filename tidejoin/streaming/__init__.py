"""The maintained view as a Structured Streaming job, with its state in versioned Parquet."""
