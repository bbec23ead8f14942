"""Column-level functions: every one returns a ``Column`` (JVM-side, codegen'd)."""

from flowlens.functions.arith import rate, to_mb, flag  # noqa: F401
from flowlens.functions.ip import is_private_ip  # noqa: F401
from flowlens.functions.ports import extract_ports  # noqa: F401
from flowlens.functions.protocol import proto_label, ics_protocol_name  # noqa: F401
from flowlens.functions.timefns import (  # noqa: F401
    time_bucket, dt_hour, dt_weekday, dt_diff_seconds, epoch_seconds, parse_timestamp,
)
