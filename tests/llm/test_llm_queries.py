"""Every registered query of the corpus operators on whole small tables: against SQL, the library or brute force."""

import hashlib
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.llm import quality_rules
from cohortry.llm.queries import ORACLES, QUERIES
from cohortry.llm.tokens import BYTE_BPE, WORD_BPE
from cohortry.sources.shared import materialize, shared_dir
from test_llm import ODD, SCHEMA, brute_spans, classes, library, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: Counter(tuple("" if pd.isna(x) else f"{int(x)}" if isinstance(x, float) and x.is_integer() else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_op2(spark, docs):
    kinds = ("email", "ip", "card", "phone")
    got = {r.doc_id: r for r in QUERIES["op2_pii_supervision"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        base = brute_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for k, spans in zip(kinds, base, strict=True) for s, e in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in kinds] == [len(x) for x in base]
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))


def test_op3(spark, docs):
    lib, start = library(WORD_BPE), 0
    got = {r.doc_id: r for r in QUERIES["op3_seekable_tokens"](spark, SF).collect()}
    for d, t in docs:
        ids = np.append(lib(t), np.uint32(1)).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4(spark, docs):
    lib = library(BYTE_BPE)
    got = QUERIES["op4_best_fit_packing"](spark, SF).toPandas()
    want = {}
    for d, t in docs:
        ids = np.append(lib(t), np.uint32(0)).astype("<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(d, k): (a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048
    assert set(got.sequences) == {got.sequence_id.nunique()} and got.least_sequences.max() <= got.sequence_id.nunique()
    assert got.least_sequences.max() >= -(-got.length.sum() // 2048)


def test_op5(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from cohortry.llm import token_counts

    u = Tokenizer(models.Unigram(token_counts.vocabulary(token_counts.public_tokenizers.path(token_counts.PIECES)), 0, True))
    u.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_viterbi_counts"](spark, SF).collect()}
    assert got == {d: len(u.encode(t).ids) for d, t in docs}


def test_op7(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_weighted_sampling"](spark, SF).collect()}
    prints = {}
    for k, (d, t) in enumerate(docs):
        after, r = docs[(k + 1) % len(docs)], got[d]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[1][:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        share = lambda a, b: sum(a[i : i + 7] == b[i : i + 7] for i in range(0, len(a), 7)) / (len(a) / 7)
        assert r.near_edited == pytest.approx(share(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(share(r.fingerprint, got[after[0]].fingerprint))


def test_op8(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, _ in docs:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.5)


def test_op10(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_simhash_covering"](spark, SF).collect()}
    fps = [slow_fingerprint(t) for _, t in docs]
    root = classes(fps)
    for k, (d, _) in enumerate(docs):
        assert (got[d].fingerprint, got[d].component_id) == (f"{fps[k]:016x}", docs[root[k]][0])


def test_quality_statistics_stay_below_the_filter(spark):
    """The optimiser doesn't copy a statistic into each of the rules' bounds."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_rules.filter_quality(docs, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_extract_all" in x for x in plan) and not any("Filter" in x.split("(")[0] and "regexp_extract_all" in x for x in plan)


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(get=lambda key, default=None: default)
    fake = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_pipeline_on_odd_and_empty_tables(spark):
    import corpus_pipeline as cp

    clash = {"_row": F.lit("z"), "_stats": F.lit(3), "_times": F.lit("t"), "node": F.lit(1), "a.b": F.lit(4), "keys": F.lit("k")}
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns(clash)
    for docs in (odd, spark.createDataFrame([], SCHEMA).withColumns(clash)):
        before = docs
        for k, (_, stage) in enumerate(cp.STAGES):
            after = materialize(stage(spark, before, SF), f"odd-{k}")
            if k < len(cp.STAGES) - 1:
                assert after.columns == docs.columns and after.distinct().join(before, docs.schema.fieldNames()[:1], "left_anti").filter("doc_id IS NOT NULL").count() == 0
                before = after
        if docs is odd:
            assert after.select("sequence_id", "offset").distinct().count() == after.count() >= before.count()
        else:
            assert after.count() == 0


def test_pipeline_runs_and_cleans_up(spark):
    import corpus_pipeline as cp
    from cohortry.sources.shared import Scratch, file_system

    fs, at = file_system(spark, shared_dir(spark))
    names = lambda: {f.getPath().getName() for f in fs.listStatus(at)} if fs.exists(at) else set()
    before = names()
    out = cp.run(spark, SF)
    assert out.count() > 0 and not Scratch.blocks()
    left = {n.rsplit("-", 1)[0] for n in names() - before}
    assert "stage-3" in left and not left & {"stage-0", "stage-1", "stage-2", "fingerprints", "buckets", "bands"}  # the last stage reads the fourth's
