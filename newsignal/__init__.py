"""newsignal: a Spark-first analytics engine for news and text signals."""

__version__ = "0.1.0"
