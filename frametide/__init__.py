"""Recording analytics on Spark: sources, operators, statistics and plans for frame-level measurements."""
