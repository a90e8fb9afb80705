"""Relational and time-series operators over bars, samples, features and events."""
