"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, language_model, mixing, pieces, quality, repeats, simhash, tool_calls, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_repeats": repeats.op2_repeats,
    "op3_lm_scores": language_model.op3_lm_scores,
    "op4_quality": quality.op4_quality,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_tool_calls": tool_calls.op6_tool_calls,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_warc": warc.op10_warc,
}
SQL = {"op6_tool_calls": tool_calls.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op10_warc": warc.OP10_SQL}
