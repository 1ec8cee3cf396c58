"""Configuration, templates and the running of load tasks."""
