"""Query op3: BPE encoding and decoding of whole documents."""

import public_tokenizers

from .bpe import bpe_encode
from .spool import read


def query(spark, sf_dir):
    docs = read(spark, sf_dir)
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
