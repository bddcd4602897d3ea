"""Readers: event adapter, first existing path, required columns, road graphs, stored bundles, configuration."""
