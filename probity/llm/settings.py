"""Production parameters that more than one query uses."""

#: Domains of the sources and target weights of domains, languages and sources, for mixtures.
DOMAINS = {f"src{i}": d for d, ids in {"web": range(0, 8), "reference": range(8, 13), "forum": range(13, 18)}.items() for i in ids}
WEIGHTS = ({"web": 4, "reference": 3, "forum": 2, "other": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {"src0": 1})
