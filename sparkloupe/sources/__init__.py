"""Readers: trees, git, reports, history, configuration."""
