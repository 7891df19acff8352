"""panelwise: DataFrame operators for entity-by-period panels on Spark."""
