"""Readers and writers: JSON lines, whole JSON, CSV, stage logs, manifests, result caches, Markdown."""
