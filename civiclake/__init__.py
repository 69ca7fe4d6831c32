"""Open-data analytics as Spark DataFrame operators."""

from civiclake.session import Tables, session, work_dir

__all__ = ["Tables", "session", "work_dir"]
