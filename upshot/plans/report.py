"""R-3: the five-table result bundle written as datasets."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..sources.files import write_result
from .registry import REGISTRY

# table name -> registered query producing it (fixed layout of the bundle)
BUNDLE = {
    "overall": "e10_matched_arr",
    "cluster": "k11_cluster_profile",
    "engagement_type": "e9_type_lift_vs_control",
    "direct_vs_attributed": "e7_direct_vs_attributed",
    "effectiveness": "e11_effectiveness",
}


def write_bundle(spark: SparkSession, sf_dir: str, out_dir: str, parts=None,
                 fmt: str = "parquet") -> dict[str, str]:
    """Compute and write the bundle tables; returns table -> path."""
    from . import load_all
    load_all()
    written = {}
    for table, query in BUNDLE.items():
        if parts is not None and table not in parts:
            continue
        path = os.path.join(out_dir, table)
        write_result(REGISTRY[query].build(spark, sf_dir), path, fmt=fmt, single_file=True)
        written[table] = path
    return written
