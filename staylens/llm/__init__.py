"""Operations of a training-data pipeline: archive, formatting, near-dedup, language, quality, tokens, HTML, mixing, shards.

Each module holds one operator with its own general interface; ``registry``
holds the thin registered queries.  Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
