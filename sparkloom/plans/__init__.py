"""Stages as DataFrame plans, and the queries over the driver's tables with their SQL twins."""
