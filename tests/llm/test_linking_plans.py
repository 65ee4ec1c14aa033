"""Plans of the linking steps read written tables: the driver's memory follows the size of its plans, not their rows."""

import numpy as np
import pytest

from factorseg.llm import graph, words
from factorseg.llm.jaccard_join import jaccard_components
from factorseg.llm.substring_dedup import repeated_passages
from factorseg.operators import lineage

MOST_SCANS = 6


@pytest.fixture
def scans(monkeypatch):
    """Tables read by each plan that is written or gathered, a table once for each place in the plan."""
    seen = []

    def counted(f):
        def call(df, *args, **kwargs):
            seen.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
            return f(df, *args, **kwargs)
        return call

    monkeypatch.setattr(graph, "written", counted(lineage.written))
    monkeypatch.setattr(lineage, "written", counted(lineage.written))
    monkeypatch.setattr(words, "id_bitmap", counted(words.id_bitmap))
    return seen


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    shared = text(50)
    rows = [(i, f"{text(40)}\n{shared}\n{text(40)}" if i % 3 else text(120)) for i in range(12)]
    rows += [(100 + i, rows[i][1] + " tail" * (i % 2)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_plans_of_passages_are_small(docs, scans):
    out = repeated_passages(docs).filter("removed").select("doc_id").distinct().collect()
    assert {r.doc_id for r in out} == {i for i in range(12) if i % 3 and i > 1} | set(range(100, 106))
    assert scans and max(scans) <= MOST_SCANS


def test_plans_of_text_links_are_small(docs, scans):
    out = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert all(out[100 + i] == out[i] for i in range(6)) and len({out[i] for i in (0, 3, 6, 9)}) == 4
    assert scans and max(scans) <= MOST_SCANS
