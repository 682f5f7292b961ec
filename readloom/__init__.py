"""readloom: approximate containment joins of short sequences against a labelled collection, on PySpark."""
