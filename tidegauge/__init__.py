"""tidegauge: I/O telemetry analytics expressed as Spark DataFrame plans."""
