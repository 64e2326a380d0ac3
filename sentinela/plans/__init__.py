"""Plans: query catalog, SQL oracles and the batch pipeline."""
