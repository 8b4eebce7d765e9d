"""Operators of a training-data pipeline: near-dedup, neighbour search, mixing, LM
scoring, WARC, toxicity, byte-level BPE, exact top-k, secret scans, main-text extraction,
conversation prefix trie, source divergence, URL filters."""
