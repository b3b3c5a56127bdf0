import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from nearcite.session import drop_materialized, local_session  # noqa: E402

LINKS = "array<struct<publication_number:string>>"
NAMES = "array<struct<name:string,country:string>>"
CORPUS_DDL = (
    "publication_number string, application_number string, filing_date int, publication_date int, grant_date int, "
    "title struct<value:string>, abstract struct<value:string>, embedding_v1 array<double>, "
    f"cited_by {LINKS}, citation {LINKS}, parent {LINKS}, child {LINKS}, "
    f"assignee_harmonized {NAMES}, inventor_harmonized {NAMES}, primary_assignee string, primary_inventor string, "
    "cpc array<struct<code:string>>, top_terms array<struct<value:string>>"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", name="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    drop_materialized(session)
    session.stop()


def document(pub, vector=None, **values):
    """One corpus row; link values are lists of ids."""
    row = {
        "publication_number": pub,
        "application_number": values.get("application", "0"),
        "filing_date": values.get("filing_date", 20100101),
        "publication_date": 20110101,
        "grant_date": values.get("grant_date"),
        "title": (values.get("title", f"title {pub}"),),
        "abstract": (values.get("abstract", f"abstract {pub}"),),
        "embedding_v1": vector,
        "assignee_harmonized": [(n, "US") for n in values.get("assignees", [])],
        "inventor_harmonized": [(n, "US") for n in values.get("inventors", [])],
        "primary_assignee": next(iter(values.get("assignees", [])), None),
        "primary_inventor": next(iter(values.get("inventors", [])), None),
        "cpc": [(c,) for c in values.get("cpc", [])],
        "top_terms": [(t,) for t in values.get("terms", [])],
    }
    for name in ("cited_by", "citation", "parent", "child"):
        row[name] = None if values.get(name, []) is None else [(p,) for p in values.get(name, [])]
    names = [part.split()[0] for part in CORPUS_DDL.replace("struct<name:string,country:string>", "x").split(", ")]
    return tuple(row[n] for n in names)


@pytest.fixture(scope="session")
def make_corpus(spark):
    return lambda rows: spark.createDataFrame([document(*a, **k) for a, k in rows], CORPUS_DDL)


def as_set(df, *columns):
    return {tuple(row) for row in df.select(*columns).collect()}
