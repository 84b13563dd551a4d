"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import bitsliced, decontaminate, mixing, warc
from chronolith.llm.bitsliced import op8_topk_search
from chronolith.llm.decontaminate import op5_decontamination
from chronolith.llm.langid import op9_language_id
from chronolith.llm.jaccard import op7_ngram_jaccard_join
from chronolith.llm.lattice import op10_lm_scores
from chronolith.llm.mixing import op2_source_mix
from chronolith.llm.template import op4_main_text
from chronolith.llm.tokens import op1_token_counts
from chronolith.llm.toxicity import op6_toxicity
from chronolith.llm.warc import op3_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mix": op2_source_mix,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_main_text": op4_main_text,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_topk_search": op8_topk_search,
    "op9_language_id": op9_language_id,
    "op10_lm_scores": op10_lm_scores,
}

ORACLES: dict[str, str] = {
    "op2_source_mix": mixing.ORACLE,
    "op3_warc_revisits": warc.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op8_topk_search": bitsliced.ORACLE,
}
