"""Composed jobs and the adapters that map the driver's tables onto the paper model."""
