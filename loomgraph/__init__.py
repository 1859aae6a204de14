"""loomgraph: a PySpark engine for line-cited knowledge graphs over source trees."""

__all__ = ["tables", "durable"]
