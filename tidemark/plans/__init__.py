"""Query plans over the star schema and event tables, and whole pipelines."""
