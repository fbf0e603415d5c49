"""popweave: survey microdata and small-area estimates as Spark DataFrame operators."""

__version__ = "0.1.0"
