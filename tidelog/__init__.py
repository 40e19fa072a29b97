"""Change-log capture, snapshots and point-in-time restore as Spark DataFrame jobs."""
