"""All queries of this package."""

from odflux.llm import (
    chat,
    html_text,
    lexical,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    token_store,
    topk,
    vector_codes,
    warc,
)  # noqa: F401
from odflux.llm.registry import ORACLES, QUERIES  # noqa: F401
