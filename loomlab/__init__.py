"""loomlab: the data work of a machine-learning lab as PySpark jobs."""
