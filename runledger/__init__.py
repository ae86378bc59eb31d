"""Run telemetry analytics for AI-agent runs, expressed as Spark jobs over all runs at once."""
