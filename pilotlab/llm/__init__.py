"""Operators for training corpora: licences, lines, packing, quality, personal data, language-model
scores, exact search, byte-pair encoding, similarity joins and coded token files.

Nothing else in the library imports this subpackage.
"""
