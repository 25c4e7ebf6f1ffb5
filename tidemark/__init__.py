"""tidemark: time-series research and corpus preparation as PySpark DataFrame jobs."""
