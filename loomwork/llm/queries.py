"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import leakage, merkle, mixing, packing, pii, sampling, tokens
from loomwork.scratch import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": lambda s, d: sampling.short_categories(t(s, d, "problem_collected"), t(s, d, "sample_target"), key_cols=["row_id"]),
        "p1_report": lambda s, d: sampling.sample_report(t(s, d, "problem_collected"), t(s, d, "sample_target"), key_cols=["row_id"]),
        "p1_sample": lambda s, d: sampling.sample_to_targets(t(s, d, "problem_collected"), t(s, d, "sample_target"), key_cols=["row_id"]).select("row_id", "level", "mode"),
        "p3_found": lambda s, d: merkle.copies(t(s, d, "problem_collected")),
        "p3_records": lambda s, d: merkle.distinct_records(t(s, d, "problem_collected")),
        "p4_found": lambda s, d: mixing.short_sources(t(s, d, "corpus_row"), t(s, d, "mix_target")),
        "p4_mix": lambda s, d: mixing.mix_sources(t(s, d, "corpus_row"), t(s, d, "mix_target")),
        "p4_report": lambda s, d: mixing.mix_report(t(s, d, "corpus_row"), t(s, d, "mix_target")),
        "p5_tokens": lambda s, d: tokens.tokens_by_row(t(s, d, "corpus_row")),
        "p5_totals": lambda s, d: tokens.token_totals(t(s, d, "corpus_row")),
        "p7_packed": lambda s, d: packing.pack_documents(t(s, d, "documents"), t(s, d, "container")),
        "p7_report": lambda s, d: packing.packing_report(packing.pack_documents(t(s, d, "documents"), t(s, d, "container"))),
        "p8_found": lambda s, d: leakage.leaked_items(t(s, d, "documents"), t(s, d, "eval_item")),
        "p8_passages": lambda s, d: leakage.leaked_passages(t(s, d, "documents"), t(s, d, "eval_item")),
        "p9_found": lambda s, d: pii.distinct_finds(t(s, d, "documents")),
        "p9_redacted": lambda s, d: pii.redact(t(s, d, "documents")),
        "p8_covered": lambda s, d: leakage.covered_items(t(s, d, "documents"), t(s, d, "eval_item")),
    }
