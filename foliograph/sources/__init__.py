"""Sources and sinks: file patterns and PDF object graphs."""
