"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.chat import ORACLE_SQL as CHAT_SQL
from tidewell.llm.chat import op8_chat
from tidewell.llm.decontaminate import ORACLE_SQL as DECONTAMINATION_SQL
from tidewell.llm.decontaminate import op9_decontamination
from tidewell.llm.merkle import op13_manifest
from tidewell.llm.mixing import op12_mixing
from tidewell.llm.outliers import op5_robust_outliers
from tidewell.llm.packing import op7_packing
from tidewell.llm.quality import op2_quality
from tidewell.llm.sharding import op3_sharding
from tidewell.llm.simhash import op4_simhash
from tidewell.llm.tables import table
from tidewell.llm.toxicity import op1_toxicity
from tidewell.llm.urlfilter import ORACLE_SQL as URL_FILTER_SQL
from tidewell.llm.urlfilter import op6_url_filter
from tidewell.llm.warc import ORACLE_SQL as WARC_SQL
from tidewell.llm.warc import op10_warc
from tidewell.llm.whitening import op11_whitening


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality": op2_quality,
        "op3_sharding": _over("documents", op3_sharding),
        "op4_simhash": _over("documents", op4_simhash),
        "op5_robust_outliers": _over("documents", op5_robust_outliers),
        "op6_url_filter": _over("pages", op6_url_filter),
        "op7_packing": _over("documents", op7_packing),
        "op8_chat": _over("conversations", op8_chat),
        "op9_decontamination": op9_decontamination,
        "op10_warc": _over("pages", op10_warc),
        "op11_whitening": _over("embeddings", op11_whitening),
        "op12_mixing": _over("documents", op12_mixing),
        "op13_manifest": _over("documents", op13_manifest),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": URL_FILTER_SQL,
        "op8_chat": CHAT_SQL,
        "op9_decontamination": DECONTAMINATION_SQL,
        "op10_warc": WARC_SQL,
    }
