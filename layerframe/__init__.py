"""layerframe: layered-crystal microscopy analytics as Spark DataFrame jobs."""

from .session import get_session

__all__ = ["get_session"]
