"""View operators: filters, joins, aggregation, level of detail, table calculations, shapes."""
