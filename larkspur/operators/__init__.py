"""DataFrame operators over trajectory and evaluation tables."""
