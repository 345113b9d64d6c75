"""The pipeline against a plain version of each stage, run on what the stage before it left."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_near_copies import plain_kept
from textquarry.llm import mixing
from textquarry.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stored(stage(spark, docs, SF), "stage")
        out.append((name, docs, new))
        docs = new
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert not set(rows(after)) - set(rows(before)) and 0 < after.count() <= before.count()


def test_quality_stage(stages):
    _, before, after = stages[0]

    def fails(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
        return len(words) < 50 or 100 * len(covered) > 50 * len(words)

    assert rows(after) == [r for r in rows(before) if not fails(r[1])]


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    kept = set(plain_kept(rows(before)))
    assert rows(after) == [r for r in rows(before) if r[0] in kept]


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = words(r.text)
        grams |= {tuple(item[i : i + 10]) for i in range(max(1, len(item) - 9))}

    def hit(text):
        found = words(text)
        return any(tuple(found[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(found) - n + 1))

    assert rows(after) == [r for r in rows(before) if not hit(r[1])]


def test_mixing_stage(spark, stages):
    _, before, after = stages[3]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fit = mixing.mixing_rates(before, labels, headroom=1.1)
    rate = {r["carried"]["doc_id"]: (r["rate"], r["n_tokens"]) for r in fit.rated.collect()}
    token = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
    for r in rows(before):
        assert abs(rate[r[0]][1] - len(token.findall(r[1].lower()))) <= 0.02 * rate[r[0]][1] + 2
    kept = {r[0] for r in rows(after)}
    assert {d for d, (x, _) in rate.items() if x >= 1} <= kept and not {d for d, (x, _) in rate.items() if x == 0} & kept


def test_token_stage(stages):
    _, before, after = stages[4]
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in rows(before):
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(after) == want


def test_run_is_the_stages_one_after_the_other(spark, stages):
    assert rows(entry.queries()["pipeline"](spark, SF)) == rows(stages[-1][2])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_documents_pass_through_every_stage(spark, make):
    text = " ".join(f"w{i}" for i in range(80))
    odd = make([(None, None), (None, text), (1, text), (1, text), (2, "x " * 200_000), (3, "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stored(stage(spark, odd, SF), "odd")
    assert [r.doc_id for r in odd.collect()] == [1]


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
