"""An extension: the munging stages that look at one row only, over a stream.

The percentile behind the default n_min and first-of-a-SNP need the whole table, so a stream takes an
explicit n_min, and duplicates are dropped within a batch by the batch job that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import munging


def row_stages(stream: DataFrame, opts: munging.MungeOptions) -> DataFrame:
    """P range, Z, n_min, frequency, INFO and alleles of typed canonical columns."""
    if opts.n_min <= 0:
        raise ValueError("a stream needs an explicit n_min")
    df = munging.derive_z(munging.p_in_range(stream), opts.signed_sumstats, opts.a1_inc)
    df = munging.info_at_least(munging.frequency_above(munging.n_at_least(df, opts.n_min), opts.maf_min), opts.info_min)
    return df if opts.no_alleles else munging.alleles_valid(df)
