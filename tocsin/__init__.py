"""Early-warning analytics over many time series and event streams, expressed as Spark jobs."""
