"""timeloom: time-aligned analytics as Spark DataFrame functions."""
