"""Query op7: near-duplicate components of whole documents."""

from .near_dedup import near_duplicates
from .spool import read


def query(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir))
