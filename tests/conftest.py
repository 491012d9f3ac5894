import os
import sys

import pytest
from pyspark.sql.readwriter import DataFrameWriter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nitrogrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("nitrogrid-tests", cpus=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    """Run a frame; the most rows that one node of its plan has made."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    most, open_ = 0, [query.executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        open_ += [node.children().apply(n) for n in range(node.children().size())]
    return most


def watch_writes(monkeypatch):
    """A list that takes, for each frame written from now on, the most rows that one node of its plan makes."""
    found, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        found.append(most_rows(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return found
