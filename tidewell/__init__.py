"""tidewell: event-and-place catalogue analytics, written for Spark DataFrames."""
