"""Table profiling, retrieval and answer scoring as Spark jobs."""
