import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """``documents(text, ...)``: a table of these texts, or of whole rows."""

    def make(*rows):
        made = []
        for i, row in enumerate(rows):
            text = row if row is None or isinstance(row, str) else None
            made.append((i, text, "en", f"s{i % 2}", len(text or "")) if row is None or isinstance(row, str) else row)
        return spark.createDataFrame(made, DOCUMENTS)

    return make
