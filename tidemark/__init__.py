"""Stream-timeline and transcript analytics as partition-parallel Spark jobs."""
