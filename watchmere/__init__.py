"""Behaviour analytics over security logs, written as Spark jobs."""

__version__ = "0.1.0"
