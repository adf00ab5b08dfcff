"""Anti-money-laundering risk analytics expressed as Spark DataFrame jobs."""
