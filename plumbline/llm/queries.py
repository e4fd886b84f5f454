"""All queries of this package; importing an operator's module registers its query."""

from . import op01_warc, op02_toxicity, op03_language, op04_lines, op05_bpe, op06_fertility, op07_mix, op08_minhash, op09_merkle, op10_anchors, op11_variants, op12_simhash, op13_infill
from .common import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES", "op01_warc", "op02_toxicity", "op03_language", "op04_lines", "op05_bpe", "op06_fertility", "op07_mix", "op08_minhash", "op09_merkle", "op10_anchors", "op11_variants", "op12_simhash", "op13_infill"]
