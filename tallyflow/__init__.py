"""tallyflow: usage-cost analytics over agent session logs, written as Spark DataFrame jobs."""
