"""All queries of this subpackage with their SQL."""

from lociweave.llm import centroids, decontamination, licenses, linededup, lm, mixing, negatives, quality, repair, sharding, simhash, tokens, warc

_MODULES = (quality, sharding, tokens, licenses, simhash, mixing, decontamination, linededup, repair, lm, negatives, centroids, warc)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
