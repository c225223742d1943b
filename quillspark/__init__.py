"""Document-pipeline analytics on Spark: pure ``DataFrame -> DataFrame`` operators."""
