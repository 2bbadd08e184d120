"""Web-page snapshots as tables: Markdown, actions, routing, cache replay and evaluation as Spark jobs."""
