"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tickloom.llm.alignment import op12_token_alignment
from tickloom.llm.embedding_dedup import op7_embedding_dedup
from tickloom.llm.hard_negatives import op13_hard_negatives
from tickloom.llm.lang_id import op11_lang_id
from tickloom.llm.license_scan import OP1_SQL, op1_license_scan
from tickloom.llm.line_dedup import OP10_SQL, op10_line_dedup
from tickloom.llm.mixing import OP4_SQL, op4_mix_sources
from tickloom.llm.ngram_join import op3_ngram_join
from tickloom.llm.quality import op2_quality
from tickloom.llm.sentencepiece_io import op5_sentencepiece
from tickloom.llm.tiff import op8_tiff_pages
from tickloom.llm.tokencount import op6_token_counts
from tickloom.llm.toxicity import op9_toxicity

LLM_QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_tiff_pages": op8_tiff_pages,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_lang_id": op11_lang_id,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

LLM_ORACLE_SQL = {
    "op1_license_scan": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op10_line_dedup": OP10_SQL,
}
