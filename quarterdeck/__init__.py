"""Panel analytics on Spark: lazy DataFrame plans for entity-by-period data."""
