import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mdlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = {
    "category": "Yard", "status": "Running", "owner": "crew-2", "tags": "[]",
    "created": "2025-11-03", "last_reviewed": "2025-12-24",
}


def page(body="", **fields):
    """A document with the usual fields; None leaves a field out."""
    merged = {k: v for k, v in {**BASE, **fields}.items() if v is not None}
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in merged.items()) + f"---\n{body}\n"


@pytest.fixture
def make_docs(spark):
    def build(**texts):
        return spark.createDataFrame(list(texts.items()), "path string, text string")

    return lambda texts: build(**texts)


@pytest.fixture
def make_pages(make_docs):
    from mdlake.sources.pages import page_table

    return lambda texts, **options: page_table(make_docs(texts), **options)
