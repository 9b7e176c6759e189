"""Evidence ranking on Spark: DataFrame operators from document JSON to audited rankings."""
