"""threadlens: analytics over threaded social comments, planned by Spark."""
