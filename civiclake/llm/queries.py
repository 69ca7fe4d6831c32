"""All queries of this folder, in the order of their numbers."""

from civiclake.llm import license_scan, pii, substring_dedup, quality, line_dedup  # noqa: F401, I001
from civiclake.llm import sentencepiece_ids, bagminhash, nearest, token_counts, decontaminate  # noqa: F401
from civiclake.llm import collocations, fill_in_middle, language_id  # noqa: F401
from civiclake.llm.suite import LLM

__all__ = ["LLM"]
