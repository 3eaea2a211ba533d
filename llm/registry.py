"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from llm import decontaminate, fingerprint, html_text, jaccard, langid, pieces, pii, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_language_id": langid.op6_language_id,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_text": html_text.op9_html_text,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_decontamination": decontaminate.SQL,
    "op7_warc_revisits": warc.SQL,
    "op10_ngram_jaccard": jaccard.SQL,
}
