"""Dataset operators: rules, joins, windows, aggregates, routing, enrichment, lineage."""
