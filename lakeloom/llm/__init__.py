"""Operators that prepare text corpora: deduplication, token counts, packing, classifiers, decontamination, files."""
