"""Query catalogue and composite pipelines."""
