"""flowlens: network-flow anomaly analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, aggregates, joins and
time windows, so the same plan runs on a laptop or a cluster.
"""

import sys as _sys


def _ship_by_value() -> None:
    """Executor-side Python (forest growth and scoring, capture decoding) is
    pickled by value, so executors need no installed copy of this package
    (no ``--py-files``), whatever the driver's working directory."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

from flowlens.session import get_spark, checkpoint_dir  # noqa: E402,F401

__version__ = "0.1.0"
