"""Fits that no built-in aggregate expresses, each a grouped job."""
