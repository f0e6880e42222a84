"""Operators for text corpora: dedup, tokens, chat, decontamination, language, URLs."""
