"""The last stage of the pipeline decodes what it encodes."""

import hashlib


def test_tokens_stage_gives_the_digest_of_the_decoded_bytes(spark, edges):
    import corpus_pipeline as cp

    out = cp.tokens(spark, edges, "").collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in out) == sorted(digest(r.text) for r in edges.collect())
