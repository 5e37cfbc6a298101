"""Training-data operators: packing, decontamination, toxicity, suffix dedup, chat
rendering, sharding, near-duplicates, quality rules, URL filters and WARC conversion.

Nothing outside this subpackage imports it; delete the folder and the rest still works.
"""
