"""Column functions: time in milliseconds, window and segment arithmetic, codecs."""

from .codec import order_preserving_base64
from .ranges import Bound, KeyRange
from .time import hopping_starts, millis, segment_interval, segment_start, stream_time, tumbling_start, window_end

__all__ = ["Bound", "KeyRange", "hopping_starts", "millis", "order_preserving_base64", "segment_interval", "segment_start", "stream_time", "tumbling_start", "window_end"]
