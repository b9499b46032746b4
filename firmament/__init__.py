"""Panel, dated-graph and news-text analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
