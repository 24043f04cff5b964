"""The queries of this subpackage; importing the operator modules fills the registry."""

from voxelloom.llm import (  # noqa: F401
    alignment,
    centroids,
    chat,
    decontaminate,
    exact_dedup,
    html_text,
    line_dedup,
    lm,
    packing,
    quality,
    secret_scan,
    simhash,
    surrogates,
)
from voxelloom.llm.common import ORACLE, QUERIES  # noqa: F401
