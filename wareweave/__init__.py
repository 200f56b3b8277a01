"""Product price comparison and corpus preparation as Spark DataFrame jobs."""
