"""Training-data operators: de-duplication, decontamination, mixing, token output and filters.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
