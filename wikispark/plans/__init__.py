"""The registered queries: fixtures from the driver's tables, Spark plans and their SQL."""
