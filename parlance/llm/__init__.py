"""Operators for preparing training corpora: language, sharding, search, repeats, filters, archives, scores, packing, joins."""
