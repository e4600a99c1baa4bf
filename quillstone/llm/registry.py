"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from quillstone.llm import fingerprints, url_filters, warc
from quillstone.llm.conversations import op12_conversation_repair
from quillstone.llm.html_wrappers import op6_html_extraction
from quillstone.llm.licences import op1_license_scans
from quillstone.llm.mixing import op7_mixing_sources
from quillstone.llm.ngram_join import op8_ngram_jaccard_join
from quillstone.llm.packing import op10_best_fit_packing
from quillstone.llm.quality_gam import op2_quality_classifier
from quillstone.llm.quality_rules import op5_quality_rules
from quillstone.llm.runs import op13_periodic_runs
from quillstone.llm.sharding import op11_sharding

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_quality_classifier,
        warc.op3_warc_fixity_audit,
        url_filters.op4_url_filters,
        op5_quality_rules,
        op6_html_extraction,
        op7_mixing_sources,
        op8_ngram_jaccard_join,
        fingerprints.op9_document_fingerprints,
        op10_best_fit_packing,
        op11_sharding,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op3_warc_fixity_audit": warc.ORACLE, "op4_url_filters": url_filters.ORACLE, "op9_document_fingerprints": fingerprints.ORACLE}
