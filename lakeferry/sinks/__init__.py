"""Sinks: each prepares what it will publish, and then publishes or takes it back."""
