"""millrace: data pipelines of small relational steps, run by Spark as one lazy plan."""

__version__ = "0.1.0"
