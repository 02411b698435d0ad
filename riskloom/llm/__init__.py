"""Training-data operators: language ID, de-duplication, fingerprints, mixing, WARC, BPE, toxicity, ANN.

Nothing else in the library imports this subpackage.
"""
