"""Market-data and quantitative-research operators as Spark DataFrame jobs."""
