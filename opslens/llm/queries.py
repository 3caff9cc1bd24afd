"""The queries of this subpackage. The modules register them when imported."""

from opslens.llm import audit, chat, codes, exact, huffman, licenses, near, nearest, packing, pieces, shards, toxicity, urls  # noqa: F401
from opslens.llm.common import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
