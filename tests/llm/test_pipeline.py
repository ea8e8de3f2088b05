"""The pipeline against a version of its stages in plain Python, stage by stage and as a whole."""

import re
import struct
import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandmill.llm import packing, quality
from tests.llm.test_operators import base_entities, components_of, squeeze

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage and after the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == COLUMNS
        rows = docs.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "private", "pack"]


def test_quality_stage(spark, stages):
    scored = quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in scored if r.predicted)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    good = [i for i, q in marks.items() if q == 1]
    assert 0 < len(kept) < len(stages[0]) and sum(i in kept for i in good) > 0.95 * len(good)


def test_exact_stage(stages):
    groups = defaultdict(list)
    for r in stages[1]:
        groups[squeeze(r.text)].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in stages[2]) == sorted(min(g)[1] for g in groups.values())


def test_near_stage(stages):
    want = sorted(i for i, _, c in components_of([(r.doc_id, r.text) for r in stages[2]], 5, 80) if i == c)
    assert sorted(r.doc_id for r in stages[3]) == want


def test_private_stage(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    touched = 0
    for r in stages[4]:
        found = base_entities(before[r.doc_id] or "")
        assert r.n_chars == len(r.text) and not any(before[r.doc_id][a:b] in r.text for a, k, b in found if k == 0)
        if found:
            touched += 1
            assert r.text != before[r.doc_id]
        # What is outside the replaced spans stays in its order.
        plain = [re.escape(x) for x in re.split(r"\[[A-Z_]+\]", r.text)]
        assert "[" in (before[r.doc_id] or "") or re.fullmatch("(?s)" + ".+?".join(plain), before[r.doc_id] or "")
    assert touched


def check_pack(texts, rows):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    used, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        used[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for got, size in [*((used[i], len(ids[i])) for i in ids), *((p, None) for p in seqs.values())]:
        at = 0
        for a, n in sorted(got):
            assert a == at
            at += n
        assert at == size or size is None and at <= 2048 and at & (at - 1) == 0


def test_pack_stage(stages):
    check_pack({r.doc_id: r.text for r in stages[4]}, stages[5])


def test_run(spark, stages):
    """The written and reread pipeline is the same as its stages one by one."""
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[5])) and {r.doc_id for r in rows} == {r.doc_id for r in stages[4]}
    check_pack({r.doc_id: r.text for r in stages[4]}, rows)
