"""Every catalogue query with SQL against DuckDB; the others keep their invariants."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from affectra.plans import catalogue as C
from affectra.plans import more, training  # noqa: F401
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    empty = lambda x: pd.api.types.is_scalar(x) and pd.isna(x)
    return sorted(tuple("" if empty(x) else f"{x:.6g}" if isinstance(x, float) else str(list(x)) if isinstance(x, np.ndarray) else str(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))


def number(r):
    out = []
    for x in r:
        try:
            out.append(f"{float(x):.5g}")
        except ValueError:
            out.append(x)
    return tuple(out)


@pytest.mark.parametrize("name", sorted(C.SQL))
def test_equals_sql(spark, duck, name):
    got, want = C.QUERIES[name](spark, DATA).toPandas(), duck.execute(C.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(number, rows(got))) == sorted(map(number, rows(want)))


def test_speaker_split_covers_labels_and_leaks_nothing(spark):
    s = C.speaker_split(spark, DATA).toPandas()
    assert (s.groupby("speaker").split.nunique() == 1).all()
    assert set(s[s.split == "train"].emotion) == set(s.emotion) and set(s.split) == {"train", "valid", "test"}
    assert s.sort_values("utt_id").split.tolist() == C.speaker_split(spark, DATA).toPandas().sort_values("utt_id").split.tolist()


def test_heads_learn(spark):
    h = C.train_heads(spark, DATA).toPandas()
    for _, f in h.groupby("fold"):
        f = f.sort_values("epoch")
        assert f.train_loss.iloc[-1] < f.train_loss.iloc[0]
    assert h.fold.nunique() == 5


@pytest.mark.parametrize("name", ["train_separate_heads", "train_mediated_heads", "train_two_stages"])
def test_networks_learn(spark, name):
    h = C.QUERIES[name](spark, DATA).toPandas()
    stages = h.groupby("stage") if "stage" in h else [(1, h)]
    for stage, part in stages:
        measure = {1: "loss", 2: "emotion_loss"}[stage]
        loss = part[(part.part == "train") & (part.measure == measure)].sort_values("epoch").value
        assert len(loss) >= 2 and loss.iloc[-1] < loss.iloc[0], (name, stage)
