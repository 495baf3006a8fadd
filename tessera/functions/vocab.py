"""Vocabularies used by the recode operators.

FIXED VALUES: these must equal the label sets and indices of the studied
corpora, so they are written out as plain text, in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: part-of-speech tag -> index (17 entries, '<pad>' = 4) ---
TAG_INDEX = {
    "X": 0, "PART": 1, "AUX": 2, "PUNCT": 3, "<pad>": 4, "CONJ": 5,
    "PRON": 6, "INTJ": 7, "NOUN": 8, "VERB": 9, "NUM": 10, "SCONJ": 11,
    "DET": 12, "PROPN": 13, "ADP": 14, "ADV": 15, "ADJ": 16,
}
# --- fixed values: tag normalisation (others unchanged) ---
TAG_RENAMES = {"SYM": "X", "UNK": "X", "CCONJ": "CONJ"}
# --- fixed values: token language labels -> index (unknown -> -1) ---
LANG_LABEL_INDEX = {
    "unk": 0, "lang1": 1, "lang2": 2, "other": 3, "ne": 4, "fw": 5,
    "mixed": 6, "ambiguous": 7,
}
LANG_LABEL_UNKNOWN = -1
# --- fixed values: sentiment -> index (anything else -> null) ---
SENTIMENT_INDEX = {"negative": 0, "neutral": 1, "positive": 2}
# --- fixed values: sentence sentinels and their tag ---
CLS_TOKEN, SEP_TOKEN, PAD_TAG = "[CLS]", "[SEP]", "<pad>"

INDEX_TAG = {v: k for k, v in TAG_INDEX.items()}


def map_literal(mapping: dict) -> Column:
    """A literal ``map<k, v>`` column (small, constant-folded by Catalyst)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
