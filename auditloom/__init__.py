"""auditloom: provenance-log analytics on Spark DataFrames."""
