"""Spark-first analytics over schema-less, versioned JSON documents."""
