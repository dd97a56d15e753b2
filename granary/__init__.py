"""granary: table profiling, audit roll-ups and catalog analytics as Spark jobs."""
