"""The pipeline's stages one by one against brute force, and its whole run."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import packing
from test_operators import slow_best_fit, slow_lines, slow_quality, slow_similar, slow_targets, split

DOC = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    rng = random.Random(11)
    own = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(own) for _ in range(n)).capitalize() + "."
    shared = [line(30), line(12), line(14)]
    texts = ["\n".join(line(rng.randint(8, 20)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    texts += ["\n".join([line(15), *shared, line(15)]) for _ in range(5)] + [texts[0]] * 3 + [texts[1].replace(".", ";", 1)]
    long = [rng.choice(own) for _ in range(300)]
    texts += [" ".join([*long[:k], "changed", *long[k + 1 :]]).capitalize() + "." for k in (20, 90, 170, 250)]
    texts += [" | ".join(own[:40]), "SHOUT!! " * 30, "too short", "", None, line(400)]
    return [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """``name -> (input rows, output rows)``, each output written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.createDataFrame(corpus(), DOC), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_names_and_columns(steps):
    assert list(STAGES) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(before == after for name, (_, _, before, after) in steps.items() if name != "packing")
    assert all(r.n_chars == len(r.text) for name in ("quality_rules", "line_dedup", "near_dedup") for r in steps[name][1])


def test_quality_rules(steps):
    before, after, _, _ = steps["quality_rules"]
    kept = {r.doc_id: r.text for r in after}
    for r in before:
        if slow_quality(r.text)[-1] or "|" in r.text or "!!" in r.text:
            assert r.doc_id not in kept
        else:
            assert kept[r.doc_id] == r.text


def test_line_dedup(steps):
    before, after, _, _ = steps["line_dedup"]
    want = slow_lines([((r.doc_id, r.text), 0) for r in before])
    assert {r.doc_id: r.text for r in after} == {k[0]: v for k, v in want.items()}


def test_near_dedup(steps):
    before, after, _, _ = steps["near_dedup"]
    group = slow_similar([r.text for r in before])
    assert len(group) >= len(set(group)) + 3  # at least the three with one word changed
    assert {r.doc_id for r in after} == {min(r.doc_id for r, h in zip(before, group) if h == g) for g in set(group)} and len(after) == len(set(group))


def test_mixing(steps):
    before, after, _, _ = steps["mixing"]
    copies = Counter(r.doc_id for r in after)
    targets = slow_targets([(r.doc_id, r.text, None, r.source) for r in before])
    for s, target in targets.items():
        mine = [r for r in before if r.source == s]
        assert all(copies[r.doc_id] <= 2 for r in mine)
        assert abs(sum(copies[r.doc_id] * len(split(r.text)) for r in mine) - target) <= max(len(split(r.text)) for r in mine)
    assert set(copies) <= {r.doc_id for r in before}


def test_packing(steps):
    before, after, _, _ = steps["packing"]
    encode = packing.encoder(packing.default_tokenizer())
    lengths = [len(encode(r.text)) + 1 for r in before]
    assert sum(r.length for r in after) == sum(lengths)
    assert len({r.sequence_id for r in after}) == slow_best_fit([r.length for r in after], packing.CAPACITY)


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), DOC).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 20 and re.match("doc_id", out.columns[0])
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert not out.where(F.col("length") > packing.CAPACITY).count()
