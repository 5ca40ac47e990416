"""The pipeline against the same stages in plain code, and the entry without this subpackage."""

import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from quillon.llm import mixing
from tests.conftest import ROOT
from tests.llm.test_first import ODD, SCHEMA, check_packing
from tests.llm.test_second import brute_similar


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == docs.columns, name
    rows = [[tuple(r) for r in d.collect()] for d in steps]
    texts = {r[0]: r[1] for r in rows[0]}
    with_letters = [r for r in rows[0] if any(c.isalpha() for c in r[1] or "")]
    assert sorted(rows[1], key=repr) == sorted(with_letters, key=repr)
    low = lambda t: t.encode().lower()
    best = {}
    for r in with_letters:
        best[low(r[1])] = max(best.get(low(r[1]), r[0]), r[0])
    assert sorted(r[0] for r in rows[2]) == sorted(best.values())
    ids = sorted(best.values())
    assert sorted(r[0] for r in rows[3]) == sorted(set(brute_similar([(i, texts[i]) for i in ids])))
    plan = {r.doc_id: r for r in mixing.mix(steps[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    taken, target = defaultdict(int), {}
    for r in rows[4]:
        taken[r[3]] += len(r[1].split())
    for r in plan.values():
        target[r.source] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) < max(0.25 * t, 5000) for s, (t, _) in target.items())


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("_id", F.lit(1)).withColumn("_own", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("_copy", F.lit(1))
    shared = spark.createDataFrame([(1, "eins zwei drei", "de", "a", 3), (1, "un deux", "fr", "b", 2), (1, "un deux", "fr", "b", 2), (None, "x y z", "en", "a", 1), (None, "x y z q", "en", None, 1)], SCHEMA)
    for docs in (odd, shared, spark.createDataFrame([], SCHEMA), odd.where("text IS NULL"), odd.withColumn("source", F.lit(None).cast("string"))):
        own = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, "").cache()
            assert own.columns == docs.columns, name
            own.count()
        corpus_pipeline.STAGES[-1][1](spark, own, "").collect()


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    copies = Counter((r.doc_id, r.piece) for r in out)
    seen, once = set(), []
    for r in out:
        if (r.doc_id, r.piece) not in seen:
            seen.add((r.doc_id, r.piece))
            once.append(r)
    assert 0 < len(once) <= len(out) and max(copies.values()) <= 3
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for own in by_seq.values():
        end = 0
        for off, n in sorted(own):
            assert off == end
            end += n
        assert end <= 2048
    relaid = []
    for k, r in enumerate(once):  # places are checked above; here only the pieces' contents
        relaid.append(type(r)(**{**r.asDict(), "sequence_id": k, "offset": 0}))
    check_packing(relaid, [(i, docs[i]) for i in {r.doc_id for r in once}])


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 10 and out[2] == "False"
