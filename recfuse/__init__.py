"""recfuse: fuse conflicting claims about the same entities into one curated table, on Spark."""

from recfuse.schema import LAUNCH_PROFILE, Field, RecordProfile
from recfuse.session import build_session

__all__ = ["LAUNCH_PROFILE", "Field", "RecordProfile", "build_session"]
