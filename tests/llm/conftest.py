import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def documents(spark):
    """A function of texts, or (doc_id, text) pairs, to a documents table; further columns have clashing names."""

    def make(rows, more=()):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        schema = T.StructType([*DOCUMENTS.fields, *(T.StructField(n, T.StringType()) for n in more)])
        return spark.createDataFrame([(i, x, "en", "s", len(x or ""), *("?" for _ in more)) for i, x in pairs], schema)

    return make


CLASHES = ("piece", "start", "length", "sequence_id", "offset", "shard", "slot", "size", "fingerprint", "component_id", "n_hit", "items", "spans", "kept", "name", "anchor", "id", "score", "lang_pred", "held_out", "terms", "term", "key", "rank")


@pytest.fixture(scope="session")
def clashes():
    return CLASHES
