"""Review analytics on Spark: clean, flag spam, cluster, pick examples, report."""
