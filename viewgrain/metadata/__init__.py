"""Jobs over tables of metadata: columns, relationships, formulas, datasets, lineage."""
