"""Training-data operators: decontamination, sharding, joins, detection, mixing, quality and scoring."""
