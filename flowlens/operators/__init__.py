"""DataFrame -> DataFrame operators: timestamps, features, statistics,
packet rollup, the three detectors, the isolation forest, top-k and summary."""
