"""Training-data operators: tokenisation, pseudonyms, deduplication, quality, sharding, archives, licences, mixing.

Nothing outside this package imports it. Results for odd inputs are stated in each operator's docstring.
"""
