"""Dashboard-grade analytics as Spark jobs: views, filters, levels of detail, table
calculations, metric views, chart data and jobs over metadata tables."""
