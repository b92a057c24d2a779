"""Multi-source payment and app-activity analytics written as Spark DataFrame jobs."""
