"""Queries and oracle SQL of this subpackage."""

from pagetrail.llm import bpe, brown, collocations, exact_dedup, lexical, minhash, packing, quality, suffix_dedup, token_files, url_filter, vector_dedup, warc_zip

MODULES = (bpe, brown, collocations, exact_dedup, lexical, minhash, packing, quality, suffix_dedup, token_files, url_filter, vector_dedup, warc_zip)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
