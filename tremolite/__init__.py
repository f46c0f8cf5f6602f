"""tremolite: geo-temporal event analytics as Spark jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
