"""Training-data operators: filtering, deduplication, scoring, packing and counting of text at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
