"""Composed plans: reports, the registered query catalog and its SQL oracle."""
