"""Sources and sinks: session scans, named tables, CSV, flattening, fixtures."""
