"""End-to-end pipelines and the registered query set."""
