"""Training-data operators: near duplicates, search, tokens, licences, packing, language models, pages.

Nothing outside this subpackage imports it.
"""
