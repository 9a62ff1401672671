"""Training-data operators: toxicity, neighbours, language, licences, archives, decontamination, URLs, shards, mixing, joins, clusters, lines, infilling."""
