"""Query registry and whole pipelines."""
