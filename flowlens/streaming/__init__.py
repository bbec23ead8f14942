"""Structured Streaming entry points: micro-batch detection, closed windows, running thresholds."""

from flowlens.streaming.micro_batch import detect_stream, read_flow_stream  # noqa: F401
from flowlens.streaming.thresholds import flagged_groups, latest_thresholds, start_thresholds  # noqa: F401
from flowlens.streaming.windows import (exfil_groups, late_flows, lateral_groups, progress_rows, start_groups,  # noqa: F401
                                        stream_exfil_pairs, stream_lateral_pairs)
