"""DataFrame -> DataFrame operators built from Spark SQL expressions."""
