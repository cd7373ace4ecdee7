"""Corpus operators for training data: quality, copies, packing, token counts, URLs, secrets and licences."""
