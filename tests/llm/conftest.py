import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
sys.path[:0] = [HERE, ROOT]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns
    whose names the operators use themselves."""
    def make(rows, extra=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "shard", "key", "fp", "words", "_text", "n_words", "_key", "_row", "copies", "pack", "kept"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
