"""korpuskel: corpus analytics as lazy Spark DataFrame operators."""

from korpuskel.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
