"""Update batches as a stream."""

from .updates import MaintainedResult, update_stream

__all__ = ["MaintainedResult", "update_stream"]
