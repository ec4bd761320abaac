"""jobsight: analytics over the telemetry of batch data jobs, written as Spark jobs."""
