"""helixtab: genome-annotation analytics as Spark DataFrame operators."""
