"""Training-data operators: language ID, WARC, chat formatting, decontamination, toxicity,
mixing, embedding near-dedup, token counts, n-gram Jaccard join and line dedup.

Nothing outside this folder imports it.
"""
