"""Run catalog, pipelines and registered queries."""
