import random

import pytest

from nearcite.operators.resolve import resolve_ids
from nearcite.sources import ranges


@pytest.mark.parametrize("rows_per_range", [None, 1, 2, 100])
def test_cascade(spark, make_corpus, tmp_path, rows_per_range):
    corpus = make_corpus(
        [
            (("US-8410469-B2",), {"application": "111"}),
            (("US-8410469-B1",), {"application": "111"}),
            (("US-84104690-E1",), {"application": "222"}),
            (("US-777-S1",), {"application": "8410470"}),
            (("US-777-A9",), {"application": "8410470"}),
            (("EP-5-B1",), {"application": None}),
        ]
    )
    if rows_per_range:
        corpus = ranges.create(corpus, str(tmp_path / "corpus"), rows_per_range)
    raw = {
        "8,410,469": ("US-8410469-B1", "suffix", True),
        " us8410469 ": ("US-8410469-B1", "suffix", True),
        "us-8410469-b2": ("US-8410469-B2", "formatted", True),
        "EP-99-A1": ("EP-99-A1", "formatted", False),
        "84104690": ("US-84104690-E1", "prefix", True),
        "84": ("US-8410469-B1", "prefix", True),
        "777": ("US-777-A9", "prefix", True),
        "8410470": ("US-777-A9", "application", True),
        "US-8410469": (None, None, False),
        "": (None, None, False),
        None: (None, None, False),
        "nothing": (None, None, False),
        "999": (None, None, False),
    }
    inputs = spark.createDataFrame([(k,) for k in raw] * 2, "raw string")
    got = resolve_ids(inputs, corpus).collect()
    assert len(got) == 2 * len(raw)
    assert {r["raw"]: (r["publication_number"], r["step"], r["found"]) for r in got} == raw

    only_application = resolve_ids(inputs.where("raw = '8410470' or raw = '84104690'"), corpus, "application").collect()
    assert {r["raw"]: r["publication_number"] for r in only_application} == {"8410470": "US-777-A9", "84104690": None}
    publication = resolve_ids(inputs.where("raw = '8410470'"), corpus, "publication").first()
    assert publication["publication_number"] is None


def test_prefixes_meet_their_ranges(spark, make_corpus, tmp_path):
    rng = random.Random(8)
    keys = sorted({f"US-{rng.randrange(10 ** rng.randint(1, 5))}-{rng.choice(['B1', 'A1', 'E1'])}" for _ in range(400)} | {"EP-1-B1", "é-1", "US-"})
    store = ranges.create(make_corpus([((k,), {}) for k in keys]), str(tmp_path / "corpus"), 20)
    wanted = ["US-", "US-1", "US-12", "US-123", "E", "é", "", "zz", *(f"US-{rng.randrange(10_000)}" for _ in range(60)), None]
    got = store.best_of_prefix(spark.createDataFrame([(w,) for w in wanted], "prefix string")).collect()
    found = {w: min((len(k), k) for k in keys if k.startswith(w)) for w in set(wanted) - {None} if any(k.startswith(w) for k in keys)}
    assert {r["prefix"]: (r["size"], r["publication_number"]) for r in got} == found and len(got) == len(found)
    narrow = store.best_of_prefix(spark.createDataFrame([("US-12",)], "prefix string"))
    assert narrow.count() == 1
