"""Trip-log analytics on Spark: discovery, repair, loading and statistics of vehicle sensor logs."""
