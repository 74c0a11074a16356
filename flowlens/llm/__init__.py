"""Training-data operators on Spark tables; nothing else in the library imports this subpackage."""
