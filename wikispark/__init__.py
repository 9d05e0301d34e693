"""wikispark: a knowledge-compilation engine written as Spark DataFrame jobs."""
