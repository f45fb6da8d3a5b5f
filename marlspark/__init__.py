"""A small relational engine and data-preparation operators, native to PySpark."""
