"""What the language stage keeps."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("learned", [True, False])
def test_lettered_documents_stay_with_and_without_languages(spark, documents, learned):
    docs = documents if learned else documents.withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text) for r in found.collect())
    expected = [(r.doc_id or 0, r.text) for r in docs.collect() if r.text is not None and any(map(str.isalpha, r.text))]
    assert kept == sorted(expected) and len(kept) > 20
