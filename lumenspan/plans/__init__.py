"""Ready-made plans: the query catalogue and the lenses."""
