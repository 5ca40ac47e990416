"""quillon: a Spark-first engine for checking model output at scale."""
