"""The queries of this subpackage and their SQL; read by ``__spark_entry__.py`` if it is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, erasure, hpylm, licenses, minmax, mixing, packing, pages, repeats, spelling, topk, toxicity
from .common import release  # noqa: F401 (for whoever runs the queries: deletes what they stored)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mih_topk": topk.op1_mih_topk,
    "op2_chat_format": chat.op2_chat_format,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_telephony_audio": audio.op4_telephony_audio,
    "op5_minmax_dedup": minmax.op5_minmax_dedup,
    "op6_template_extract": pages.op6_template_extract,
    "op7_wfq_mix": mixing.op7_wfq_mix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit_pack": packing.op9_best_fit_pack,
    "op10_hpylm_score": hpylm.op10_hpylm_score,
    "op11_cascading_erasure": erasure.op11_cascading_erasure,
    "op12_substring_dedup": repeats.op12_substring_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_mih_topk": topk.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op5_minmax_dedup": minmax.OP5_SQL,
    "op7_wfq_mix": mixing.OP7_SQL,
    "op12_substring_dedup": repeats.OP12_SQL,
}
