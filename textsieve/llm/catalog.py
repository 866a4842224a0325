"""Queries of the corpus operators."""

from __future__ import annotations

from . import decontaminate, line_dedup, near_dedup, quality, sentencepieces, sharding, spotsigs, suffix_dedup, url_filter, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_quality": quality.op4_quality,
        "op5_sharding": sharding.op5_sharding,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_spotsigs": spotsigs.op7_spotsigs,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_warc": warc.op10_warc,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.OP2_SQL, "op9_url_filter": url_filter.OP9_SQL}
