"""Text sources and sinks, generators."""
