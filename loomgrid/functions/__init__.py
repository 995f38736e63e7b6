"""Column-level functions: scalar, time-series, cross-sectional and statistical."""
