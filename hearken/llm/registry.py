"""All queries of the package, by name."""

from hearken.llm import balltree, decontaminate, fingerprints, language, lines, mixing, neardup, passages, prefixtrie, tokenfile, tokens, toxicity, urls
from hearken.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "balltree", "decontaminate", "fingerprints", "language", "lines", "mixing", "neardup", "passages", "prefixtrie", "tokenfile", "tokens", "toxicity", "urls"]
