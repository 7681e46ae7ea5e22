"""Training-data operators: sharding, joins of near copies, filters, search and mixing."""
