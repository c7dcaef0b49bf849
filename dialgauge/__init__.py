"""Per-user risk features and scoring over call, SMS and web/app logs, as Spark DataFrame jobs."""

__version__ = "0.1.0"
