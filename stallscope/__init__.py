"""Wait-state analytics over message-passing traces, written as Spark jobs."""
