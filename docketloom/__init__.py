"""Spark-native analytics over a corpus of court judgments."""

from docketloom.session import build_session
from docketloom.workspace import Workspace

__all__ = ["Workspace", "build_session"]
