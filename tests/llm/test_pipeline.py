"""The pipeline's stages, each judged on its own input."""

import json

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_clean_documents_stay(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rated = stages[0].select("doc_id").join(labels, "doc_id").join(stages[1].select("doc_id", F.lit(1).alias("in")), "doc_id", "left").collect()
    clean = [r["in"] for r in rated if r.quality == 1 and r.toxic == 0]
    toxic = [r["in"] for r in rated if r.toxic == 1]
    assert sum(map(bool, clean)) >= 0.95 * len(clean)
    assert sum(map(bool, toxic)) <= 0.5 * len(toxic)  # few ratings here; held-out accuracy is tested beside


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in stages[1].collect() for w in [r.text.encode().lower().split()]}
    left = {r.doc_id for r in stages[2].select("doc_id").collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(a, b) for b in sets if b < a) for a in set(sets) - left)


def test_passages_go(stages, spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert any(t in r.text for r in stages[2].collect() for t in items)
    left = {r.doc_id for r in stages[3].select("doc_id").collect()}
    for r in stages[2].collect():
        assert (r.doc_id in left) == (not any(t in r.text for t in items))


def test_no_personal_data(stages):
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in stages[4].collect())


def test_run_is_the_stages(stages, spark):
    key = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(stages[-1])


def test_queries_are_whole(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_pii", "op3_suffix_dedup", "op4_secret_scan", "op5_quality", "op7_token_counts", "op8_minhash", "op10_mixing"):
        assert queries()[name](spark, SF).count() == n


def odd_documents(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    prose = " ".join(f"word{i % 17} lane{i % 23} stone{i % 29}" for i in range(40))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, prose, "en", "b", len(prose)), (4, prose, "en", "b", len(prose)),
        (5, prose, "en", None, len(prose)), (5, prose, "en", None, len(prose)), (6, item, "en", "a", len(item)), (6, "mail me at a.b@c.de now", "en", "a", 23), (7, "long " * 40_000, "en", "c", 200_000), (8, "+1 (152) 555-8590", "xx", "\U0001f600", 17),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and an empty table."""
    stage, docs = dict(cp.STAGES)[name], odd_documents(spark)
    got = stage(spark, docs, SF).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    if name == "minhash_near_dedup":
        assert ids == [-1, 1, 2, 3, 4, 6, 6, 7, 8]
    elif name == "decontamination":
        assert ids == [-1, 1, 2, 3, 4, 5, 5, 6, 7, 8] and [r.text for r in got if r.doc_id == 6] == ["mail me at a.b@c.de now"]
    elif name == "pii":
        text = {(r.doc_id, r.n_chars): r.text for r in got}
        assert len(got) == 11 and text[1, None] is None and text[2, 0] == "" and text[8, 7] == "<phone>" and text[6, 22] == "mail me at <email> now"
    elif name == "mixing":
        assert len(got) == 11 and all(r.taken <= 3 * r.size for r in got) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    else:
        assert set(ids) <= {-1, *range(1, 9)}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_personal_data_query_against_plain_patterns(spark):
    import hashlib

    from test_operators import base_by_regex

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries()["op1_pii"](spark, SF).collect():
        base = [f"{k}:{a}:{b}" for a, b, k in base_by_regex(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""} and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)


def test_secret_query_against_plain_patterns(spark):
    import hashlib
    import re

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op4_secret_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
