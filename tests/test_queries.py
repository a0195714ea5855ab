"""Each registered query against its SQL on the smallest folder, and the driver's contract."""

import importlib
import inspect
import sys
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from conftest import DATA
from kerbline.plans import graphs, registry
from kerbline.plans.tables import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(str), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        got, want = shaped(got), shaped(want)
        assert len(got) == len(want)
        for c in got:
            a, b = got[c].to_numpy(), want[c].to_numpy()
            bad = [i for i in range(len(a)) if not (a[i] is b[i] is None or a[i] == b[i])]
            assert not bad, (c, len(bad), a[bad[0]], b[bad[0]])
    assert np.all([c == c.strip() for c in got.columns])


@pytest.mark.parametrize(
    "name, module, operator, want",
    [
        ("grf1_betweenness", "kerbline.operators.graph", "betweenness", {"most": 3000}),
        ("grf4_closeness", "kerbline.operators.graph", "closeness", {"most": 400}),
        ("feature_table", "kerbline.plans.features", "network", {"sources": 3000, "targets": 400}),
        ("grf12_agg24_uncertainty", "kerbline.operators.gnn", "predict", {"runs": 30}),
    ],
)
def test_sources_and_runs_of_the_reference(spark, monkeypatch, name, module, operator, want):
    home = importlib.import_module(module)
    signature, seen = inspect.signature(getattr(home, operator)), {}

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(home, operator, record)
    with pytest.raises(InterruptedError):
        registry.QUERIES[name](spark, DATA)
    assert {k: seen[k] for k in want} == want


def test_all_edges_and_pairs_apart(spark):
    few = SimpleNamespace(edges=spark.createDataFrame([(2, 4, 1.0), (4, 7, 1.0), (7, 14, 1.0), (20, 22, 1.0), (30, 31, 1.0)], "u long, v long, w double"))
    assert {r.node: r.root for r in graphs.components(few).collect()} == {2: 2, 4: 2, 7: 2, 14: 2, 20: 20, 22: 20, 30: 30, 31: 30, -60: -61, -61: -61}
    assert {r.node for r in graphs.largest(few).collect()} == {2, 4, 7, 14}


def test_centralities_of_the_queries(spark):
    """All nodes are sources at this size: distances and path counts between all pairs, densely."""
    t = Tables(spark, DATA)
    edges = [(r.u, r.v, r.w) for r in t.edges.collect() if r.u != r.v]
    ids = sorted({n for e in edges for n in e[:2]})
    at, n = {x: i for i, x in enumerate(ids)}, len(ids)
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for u, v, w in edges:
        far[at[u], at[v]] = far[at[v], at[u]] = w
    step = np.where(np.eye(n, dtype=bool), np.inf, far)
    for k in range(n):
        far = np.minimum(far, far[:, k, None] + far[None, k])
    paths = np.eye(n)
    for s in range(n):
        for x in np.argsort(far[s], kind="stable")[1:]:
            if np.isfinite(far[s, x]):
                before = np.flatnonzero(np.isfinite(step[:, x]) & (np.abs(far[s] + step[:, x] - far[s, x]) <= 1e-9))
                paths[s, x] = paths[s, before].sum()
    through = np.zeros(n)
    for v in range(n):
        on = np.isclose(far[:, v, None] + far[None, v], far, rtol=0, atol=1e-9) & np.isfinite(far) & ~np.eye(n, dtype=bool)
        on[v], on[:, v] = False, False
        through[v] = (np.outer(paths[:, v], paths[v]) / np.maximum(paths, 1e-300))[on].sum()
    reach = np.isfinite(far)
    core = reach[np.argmax(reach.sum(1))]
    near = np.where(core, (core.sum() - 1) / np.where(core, np.where(reach, far, 0).sum(1), 1), 0)
    for name, score in (("net_betweenness", through), ("net_closeness", near)):
        rows = {r.id: (score[at[r.a]] + score[at[r.b]]) / 2 for r in t.segments.select("id", "a", "b").collect()}
        top = max(rows.values())
        got = {r[0]: r[1] for r in (graphs.betweenness if name == "net_betweenness" else graphs.closeness)(t).collect()}
        assert got == pytest.approx({i: v / top for i, v in rows.items()}, abs=2e-6)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_without_training_data_operators(monkeypatch):
    """Without the subpackage and the pipeline, everything else is still there."""
    for name in [m for m in sys.modules if m.startswith("kerbline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("kerbline.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    fresh = importlib.reload(contract)
    assert set(fresh.queries()) == set(registry.QUERIES)
    monkeypatch.undo()
    importlib.reload(contract)
