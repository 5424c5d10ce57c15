"""Query op4: byte-level dedup over whole documents."""

from .spool import read
from .suffix_dedup import suffix_dedup


def query(spark, sf_dir):
    return suffix_dedup(read(spark, sf_dir))
