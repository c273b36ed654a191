"""Structure, history and duplication analytics as Spark DataFrame operators."""
