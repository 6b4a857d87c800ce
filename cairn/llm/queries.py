"""Queries of the operators in this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .edit_sketch import near_query, sketch_query
from .licenses import ORACLE as LICENSES_ORACLE
from .licenses import licenses_query
from .packing import packing_query
from .pii import pii_query
from .quality_rules import rules_query
from .sentencepiece_stream import sentencepiece_query
from .simhash import simhash_query
from .site_quality import quality_query
from .toxicity import toxicity_query
from .warc import ORACLE as WARC_ORACLE
from .warc import warc_query

QUERIES = {
    "op1_licenses": licenses_query,
    "op2_quality_rules": rules_query,
    "op3_pii": pii_query,
    "op4_packing": packing_query,
    "op5_quality_classifier": quality_query,
    "op6_simhash": simhash_query,
    "op7_sentencepiece": sentencepiece_query,
    "op8_edit_sketch": sketch_query,
    "near_documents_by_edits": near_query,
    "op9_warc": warc_query,
    "op10_toxicity": toxicity_query,
}
ORACLES: dict[str, str] = {"op1_licenses": LICENSES_ORACLE, "op9_warc": WARC_ORACLE}
