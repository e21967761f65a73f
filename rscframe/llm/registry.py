"""All queries of the subpackage, and the SQL that some of them can be held against."""

from . import bpe, chat, fingerprints, htmltext, language, mixing, neardup, neighbours, quality, toxicity

MODULES = [quality, mixing, fingerprints, neardup, chat, language, toxicity, htmltext, neighbours, bpe]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
