"""Change-aware analytics over code, findings, texts and events on Spark."""
