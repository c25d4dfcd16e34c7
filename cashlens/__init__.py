"""Cash-flow underwriting over bank statements, as Spark DataFrame operators."""
