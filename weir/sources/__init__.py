"""Sources and sinks: table specifications, JSON and CSV loads, generators."""
