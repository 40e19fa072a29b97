"""All queries of this package; importing it registers them."""

from tidelog.llm import classifier, exactdup, lines, mixing, pieces, prefixes, privacy, rules, sharding, simhash, suffixes, veccodes, vecdup  # noqa: F401
from tidelog.llm.registry import ORACLES, QUERIES  # noqa: F401
