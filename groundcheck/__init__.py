"""Review analytics for mapped land features, written as PySpark DataFrame jobs."""
