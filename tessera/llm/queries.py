"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, langid, licenses, packing, quality, sharding, simhash, suffixes, superkmers, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_quality_forest": quality.query,
    "op3_permutation_sharding": sharding.query,
    "op4_template_decontamination": decontamination.query,
    "op5_simhash_anchors": simhash.query,
    "op6_warc_salvage": warc.query,
    "op7_license_similarity": licenses.query,
    "op8_language_cnn": langid.query,
    "op9_suffix_dedup": suffixes.query,
    "op10_superkmer_dedup": superkmers.query,
}

#: For those that SQL can express; the others are tested against plain versions in tests/llm.
ORACLES: dict[str, str] = {
    "op3_permutation_sharding": sharding.ORACLE,
    "op4_template_decontamination": decontamination.ORACLE,
    "op6_warc_salvage": warc.ORACLE,
    "op7_license_similarity": licenses.oracle(),
    "op10_superkmer_dedup": superkmers.ORACLE,
}
