"""Column builders: scalar expressions without any Python UDF."""
