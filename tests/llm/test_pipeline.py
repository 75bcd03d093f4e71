import importlib.util
import random
from pathlib import Path

import pytest

spec = importlib.util.spec_from_file_location("text_brute", Path(__file__).parent / "brute.py")
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

import corpus_pipeline  # noqa: E402


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    base = [words(r, r.randint(20, 60)) for _ in range(60)]
    item = words(r, 40)
    texts = base + base[:5] + [f"{base[5]} more"] + [f"{words(r, 10)}\n{base[6]}"] + [f"{words(r, 20)} {item} {words(r, 5)}"]
    texts += [" ".join(f"{w}%%%" for w in words(r, 30).split()) for _ in range(20)] + [None, ""]
    rows = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in enumerate(texts)]
    labels = [(d, int("%%%" not in (t or "")), 0) for d, t in enumerate(texts) if t and d % 5]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, item


def test_stages_against_brute_force(spark, folder):
    at, texts, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, at).select("doc_id", "text").collect()
    assert {d for d, t in enumerate(texts) if t and "%%%" not in t} <= {r.doc_id for r in good}
    assert not any("%%%" in (r.text or "") for r in good)
    good_df = docs.join(spark.createDataFrame([(r.doc_id,) for r in good], "doc_id long"), "doc_id", "left_semi")
    lines = corpus_pipeline.lines(spark, good_df, at)
    assert lines.columns == columns
    got = {r.doc_id: r for r in lines.collect()}
    want = brute.lines([(r.doc_id, r.text) for r in good])
    left = {d for d, t in ((r.doc_id, r.text) for r in good) if want[d][0] > want[d][1]}
    assert set(got) == left
    assert all(brute.sha(r.text.encode()) == want[d][2] and r.n_chars == len(r.text) for d, r in got.items())
    near = corpus_pipeline.near_copies(spark, good_df, at)
    kept = brute.near([(r.doc_id, r.text) for r in good], words=5)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {d for d, (_, _, k) in kept.items() if k}
    clean = corpus_pipeline.decontamination(spark, good_df, at)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in good if item not in (r.text or "")}


def test_run(spark, folder):
    at, texts, item = folder
    rows = corpus_pipeline.run(spark, at).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert all(item not in r.text and "%%%" not in r.text and r.copies > 0 for r in rows)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
