"""postlens: click-through features, targets and evaluation for content posts, as Spark DataFrame operators."""

__version__ = "0.1.0"
