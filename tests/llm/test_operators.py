import importlib.util
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

# by path: the discovery tests have a module of this name too
spec = importlib.util.spec_from_file_location("text_brute", Path(__file__).parent / "brute.py")
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

from latticework.llm import decontam  # noqa: E402
from latticework.llm.decontam import contained_items  # noqa: E402
from latticework.llm.exact_dedup import exact_duplicates  # noqa: E402
from latticework.llm.html_blocks import leaves  # noqa: E402
from latticework.llm.html_extract import extract_text, labelled, trained, vectors  # noqa: E402
from latticework.llm.line_dedup import dedup_lines  # noqa: E402
from latticework.llm.mixing import expected_totals, mixed  # noqa: E402
from latticework.llm.near_dedup import near_duplicates  # noqa: E402
from latticework.llm.quality import keep_good, quality_scores  # noqa: E402
from latticework.llm.substring_dedup import substring_dedup  # noqa: E402
from latticework.llm.suffix_dedup import bucket_pointers, suffix_dedup  # noqa: E402
from latticework.llm.textclass import Softmax, features, training_rows  # noqa: E402
from latticework.llm.toxicity import Automaton, learn, toxicity  # noqa: E402

#: Columns whose names the operators use inside.
CLASH = "shard int, blob string, id string, key string, bytes string, flags string, host string, path string, keep string, bands string, score double, _dummy int"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [words(r, r.choice([1, 2, 5, 30, 120])) for _ in range(20)]
    passage = words(r, 40)
    docs = base + base[:6]  # exact copies
    for t in base[3:12]:  # near copies
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    docs += [f"{words(r, 15)} {passage} {words(r, 10)}" for _ in range(4)]
    docs += [f"{passage}\n{words(r, 8)}\n\n{passage[:-3]}xyz\nOne Line.\n  one   line.", "One line.\nother\n", "", None, " \n\t ", "a", "é" * 60, "é" * 60 + "ü", passage * 30]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en" if d % 2 else None, "src0" if d % 3 else None, len(t or "")) + (None,) * 12 for d, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact(docs, texts, nothing):
    assert by_id(exact_duplicates(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(texts)
    assert exact_duplicates(nothing).count() == 0


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(map(tuple, exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=str)


def test_suffix(docs, texts, nothing):
    got = suffix_dedup(docs, with_text=True)
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_repeats(texts)
    assert suffix_dedup(nothing).count() == 0


def test_bucket_pointers_are_equal_for_equal_strings():
    r = np.random.default_rng(1)
    for depth in (9, 20, 50):
        text = r.integers(97, 99, 400).astype(np.uint8)
        text = np.r_[text, text[50:200]]
        left = len(text) - np.arange(len(text))
        p = bucket_pointers(text, left, depth)
        full = [i for i in range(len(text)) if left[i] >= depth]
        name = {}
        for i in full:
            assert name.setdefault(p[i], text[i : i + depth].tobytes()) == text[i : i + depth].tobytes()
        assert len(name) == len({text[i : i + depth].tobytes() for i in full})


def test_substring(docs, texts, nothing):
    assert by_id(substring_dedup(docs), "n_words", "n_removed", "kept_sha256") == brute.word_repeats(texts)
    assert substring_dedup(nothing).count() == 0


def test_near(docs, texts, nothing):
    assert by_id(near_duplicates(docs, words=2), "n_shingles", "component_id", "kept") == brute.near(texts)
    assert near_duplicates(nothing).count() == 0


def test_near_chain_and_many_copies(spark):
    """A chain of small changes is one component though its ends differ, and copies of hot texts are one too."""
    r = random.Random(9)
    w = words(r, 60).split()
    chain = []
    for i in range(12):
        w[5 * i % 60] = f"new{i}"
        chain.append(" ".join(w))
    rows = list(enumerate(chain + ["same words again and again"] * 50))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_id(near_duplicates(df, words=2), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_lines(docs, texts, nothing):
    assert by_id(dedup_lines(docs), "n_lines", "n_removed", "kept_sha256") == brute.lines(texts)
    assert dedup_lines(docs, passing=docs.columns).columns == docs.columns
    assert dedup_lines(nothing).count() == 0


def test_short_lines_at_the_threshold(spark):
    """Pairs of four shingles in five: similarity 0.8 exactly, in sets as small as they get."""
    r = random.Random(5)
    lines = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2000)})
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(x[:-1] for x in lines))], "doc_id long, text string")
    assert by_id(dedup_lines(df), "n_lines", "n_removed") == {1: (len(lines), 0), 2: (len(lines), len(lines))}


def test_decontamination(spark, docs, texts, nothing):
    r = random.Random(4)
    item = words(r, 40)
    edited = item.replace("a", "e", 3)
    bench = spark.createDataFrame([(1, item), (2, "tiny phrase"), (3, None), (4, " . "), (5, item)], "item_id long, text string")
    rows = [(0, f"{words(r, 30)} {item.upper()}! {words(r, 5)}", None), (1, f"x {edited} y", None), (2, words(r, 200), None), (3, "A tiny, phrase.", None), (4, "tiny phrases", None), (5, None, None), (6, "", None), (7, item[: len(item) // 2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_ids array<long>")
    got = by_id(contained_items(df, bench), "item_ids")
    assert got == {0: ([1, 5],), 1: ([1, 5],), 2: ([],), 3: ([2],), 4: ([2],), 5: ([],), 6: ([],), 7: ([],)}
    assert contained_items(nothing, bench).count() == 0
    assert all(not r.item_ids for r in contained_items(docs, bench.limit(0)).collect())


def test_decontamination_against_all_alignments(spark):
    """Items of every length, planted with edits about their budget, against the whole alignment."""
    r = random.Random(14)
    items = [(k, words(r, n)) for k, n in enumerate([1, 1, 2, 2, 3, 5, 8, 13, 21, 34])]
    rows = [(1000, None), (1001, ""), (1002, " .,; "), (1003, words(r, 4000))]
    for d in range(150):
        text = list(r.choice(items)[1])
        for _ in range(r.randint(0, 2 + len(text) // 9)):
            k = r.randrange(len(text) + 1)
            text[k : k + r.randint(0, 1)] = r.choice(["", "x", "e "])
        rows.append((d, f"{words(r, r.randint(0, 9))}{r.choice([' ', ', ', ''])}{''.join(text)}{r.choice([' ', ''])}{words(r, r.randint(0, 9))}"))
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("row", F.lit(2))
    got = contained_items(df, spark.createDataFrame([*items, (None, items[7][1])], "item_id long, text string")).collect()
    want = {d: brute.contained(t, items) for d, t in rows}
    assert sum(map(len, want.values())) > 100 and len(got) == len(rows)
    for row in got:
        assert [k for k in row.item_ids if k is not None] == want[row.doc_id], row.doc_id
        assert (None in row.item_ids) == (7 in want[row.doc_id])


def test_decontamination_sorts_no_scattered_grams(monkeypatch):
    """Texts that share grams with items, but too few in a band, are told by counts alone."""
    r = random.Random(15)
    items = [(k, words(r, 40)) for k in range(9)]
    bench = decontam.Benchmark(items)
    lots = " ".join(text[a : a + 12] for _ in range(20) for _, text in items for a in [r.randrange(len(text))])
    few = " ".join(text[:16] for _, text in items)
    assert bench.found(f"{lots} {items[3][1].upper()}, {few}") == [3]
    monkeypatch.setattr(decontam.np, "lexsort", None)
    assert bench.found(few) == bench.found(lots) == []


def test_normal_codes():
    r = random.Random(16)
    for text in ["", None, "_", "x", " İSTANBUL a_b__c ΟΔΟΣ\n", "½ Ⅷ 五 ٣", "\ud800 x", *("".join(r.choice("aZ_ .é½\n") for _ in range(r.randint(0, 20))) for _ in range(300))]:
        plain = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
        assert ((decontam.normal_codes(text) * np.uint64(pow(decontam.BASE, -1, 1 << 64))) - np.uint64(1)).tolist() == ([ord(c) for c in f" {plain} "] if plain else [])


def labelled_docs(spark):
    r = random.Random(5)
    rows, labels = [], []
    for d in range(240):
        t = words(r, 40)
        toxic, poor = d % 6 == 0, d % 4 == 1
        if toxic:
            t += " you idiot and moron " + words(r, 5)
        if poor:
            t = " ".join(f"{x}%%%" for x in t.split())
        rows.append((d, t, f"src{d % 3}", "en"))
        labels.append((d, int(not poor), int(toxic)))
    rows += [(900, None, None, None), (901, "", "src1", None), (902, "what an idi0t, a mor0n", "src1", "en")]
    labels += [(0, 1, 1), (None, 0, 1), (5000, None, None)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity(spark, nothing):
    df, labels = labelled_docs(spark)
    got = {r.doc_id: r for r in toxicity(df, labels).collect()}
    assert all((got[d].predicted == 1) == (d % 6 == 0) for d in range(240))
    assert got[902].predicted == 1 and got[900].score == got[901].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity(df.limit(5), labels.limit(0)).collect()} == {0}


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(2)
    entries = ["idiot", "worthless", "scum", "ad"]
    automaton = Automaton([(e, False) for e in entries])
    for _ in range(3000):
        w = list(r.choice(entries))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "i"])
        w = "".join(w)
        budget = {"idiot": 1, "worthless": 2, "scum": 1, "ad": 0}
        want = min(((distance(w, e), k) for k, e in enumerate(entries) if distance(w, e) <= budget[e]), default=None)
        assert automaton.match(w) == want
    assert Automaton([("chlla", True)]).match("chllaero") == (0, 0)
    assert learn([]).entries == []


def test_quality(spark, nothing):
    df, labels = labelled_docs(spark)
    df = df.withColumn("_bytes", F.lit(1)).withColumn("_p", F.lit(2)).withColumn("host", F.lit(3)).withColumn("p", F.lit(4))
    rows = quality_scores(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert sum(got[d].kept == (d % 4 != 1) for d in range(240)) >= 238
    assert len(rows) == 243 and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(nothing, labels).count() == 0
    # all priors and scores again, from the evidence, one document at a time
    at = {r.doc_id: (r.source or "", "/".join(x for x in (r.source, r.lang) if x is not None)) for r in df.collect()}
    want = brute.quality([(d, *at[d], got[d].evidence) for d in got])
    for d, (prior, score) in want.items():
        assert got[d].prior == pytest.approx(prior) and got[d].score == pytest.approx(score)
    twice = df.filter("doc_id < 3").unionByName(df.filter("doc_id < 3")).unionByName(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert quality_scores(twice, labels).count() == 7
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)


def test_quality_and_toxicity_on_held_out_rows(spark):
    """Words that only one class uses, and rows whose labels are not given."""
    df, labels = labelled_docs(spark)
    given = labels.filter("doc_id % 5 <> 0")
    got = {r.doc_id: r for r in quality_scores(df, given).collect()}
    out = [d for d in range(240) if d % 5 == 0]
    assert sum(got[d].kept == (d % 4 != 1) for d in out) >= 0.95 * len(out)
    scores = {r.doc_id: r for r in toxicity(df, labels).collect()}
    held = [d for d in range(240) if scores[d].held_out]
    assert len(held) > 50 and sum((scores[d].score >= 0.7) == (d % 6 == 0) for d in held) >= 0.95 * len(held)


def test_training_takes_six_thousand_rows_and_eight_hundred_steps(spark):
    ids = spark.range(7000).withColumnRenamed("id", "doc_id")
    rows = training_rows(ids.selectExpr("doc_id", "cast(doc_id as string) AS text"), ids.selectExpr("doc_id", "doc_id % 2 AS quality"), F.col("quality"))
    assert len(rows) == 6000
    x, y = features([t for t, _ in rows[:50]]), np.array([c for _, c in rows[:50]])
    assert (Softmax.fit(x, y, 2).weights == Softmax.fit(x, y, 2, steps=800).weights).all()


def test_mixing(spark, nothing):
    df, labels = labelled_docs(spark)
    df = df.withColumn("_tokens", F.lit(1)).withColumn("_bytes", F.lit(2)).withColumn("row", F.lit(3))
    for weights in ((0.8, 0.1, 0.1), (0.45, 0.5, 0.05)):
        out = mixed(df, labels, weights=weights).persist()
        rows = out.collect()
        total = np.zeros(3)
        for r in rows:
            total += r.tokens * r.rate * np.array(r.posterior)
        assert np.allclose(total / total.sum(), weights, atol=0.002)
        assert [x.expected for x in expected_totals(out, weights).collect()] == pytest.approx(list(total / total.sum()))
        assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
        # the same descent by hand, over plain arrays
        p, t = np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows], float)
        assert np.allclose([r.rate for r in rows], brute.rates(p, t, np.array(weights)), atol=0.01)
    assert mixed(nothing, labels).count() == 0
    ties = spark.createDataFrame([(1, "same words"), (2, "same words"), (2, "same words"), (None, "same words")], "doc_id long, text string")
    got = mixed(ties, labels).collect()
    assert len(got) == 4 and len({r.rate for r in got}) == 1 and len({r.copies for r in got if r.doc_id == 2}) == 1


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><script>x('<p>')</script></head><body><nav><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>word<br>next.<p>Second &lt;x&gt; 5 < 6</article>"
        "<section class=comments><p>I disagree with all of it.</p></section><footer>&copy; 2020</footer>"
    )
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (3, "v", "<div", 0), (4, "w", "<nav><a>x</a></nav>", 0)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in extract_text(df).orderBy("page_id").collect()]
    main = "Head & line\nFirst boldword next.\nSecond <x> 5 < 6"
    assert got[0] == (1, "u", main, len(main))
    assert [r[2:] for r in got[1:]] == [("", 0)] * 4
    assert extract_text(df.limit(0)).count() == 0
    r, right, every = random.Random(77), 0, 0
    for _ in range(60):  # pages it was not trained on
        blocks, y = labelled(r)
        p = trained().label([vectors(blocks)])[0]
        right, every = right + int(((p >= 0.5) == (y > 0.5)).sum()), every + len(y)
    assert right / every > 0.97


def test_deep_pages_take_memory_by_their_elements():
    import tracemalloc

    peaks = []
    for depth in (1000, 4000):
        tracemalloc.start()
        blocks = leaves("<div class='a b'>x" * depth)
        assert vectors(blocks).shape[0] == len(blocks) == depth
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0]


def block_measures(blocks):
    """Words and measures of blocks, one by one."""
    rows = []
    for i, b in enumerate(blocks):
        words, n = b.text.split(" "), len(b.text)
        slots = np.zeros(32)
        for w in words:
            h = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
            slots[h % 32] += 1 if h & 0x80000000 else -1
        share = lambda test: sum(map(test, b.text)) / n
        rows.append([
            *(slots * 0.4 / np.sqrt(len(words))), min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(len(words)) / 6), b.links, b.text[-1] in ".!?…:;\"”»",
            min(1.0, share(lambda c: c in ".,;!?") * 10), share(str.isupper), share(str.isdigit), i / len(blocks), 1 / (1 + i), 1 / (len(blocks) - i),
        ])
    return np.array(rows, np.float32)


def test_block_vectors_by_page():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh XYZÄßΣσς0١²,.;!?…İ中\ud800😀") for _ in range(r.randint(1, 9)))
    page = "".join(f"<div class=c{k}><p>{' '.join(word() for _ in range(r.randint(1, 400)))}</p></div>" for k in range(60))
    blocks = leaves(page)
    got = vectors(blocks)[:, 96:]
    assert np.allclose(got, block_measures(blocks), atol=1e-6)
    times = {}
    for f in (vectors, block_measures):
        for _ in range(3):
            began = time.process_time()
            f(blocks)
            times[f] = min(times.get(f, 9), time.process_time() - began)
    assert times[vectors] < times[block_measures] / 2


def test_leaves_close_what_html_closes():
    got = [(b.text, b.node.names[0] if b.node else "") for b in leaves("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<div>e</div>f<table><tr><td>g<td>h</table>")]
    assert got == [("a", "li"), ("b", "li"), ("c", "li"), ("d", "p"), ("e", "div"), ("f", got[5][1]), ("g", "td"), ("h", "td")]


def test_unlinked_groups_are_searched_whole(spark):
    """Copies with many edits of their own about one base: most are below the
    threshold to the smallest, some pairs are links all the same. Families that are
    split into blocks give the same components."""
    from latticework.llm import near_dedup

    r = random.Random(21)
    base = words(r, 200).split()
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(r.choice([2, 9, 11, 13])):
            w[r.randrange(len(w))] = f"new{r.randrange(400)}"
        rows.append((d, " ".join(w)))
        if d % 9 == 0:
            w[7] = "again"
            rows.append((1000 + d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.near(rows)
    assert len({x[1] for x in want.values()}) > 3  # not one component
    assert by_id(near_duplicates(df, words=2), "n_shingles", "component_id", "kept") == want
    whole = near_dedup.linked
    try:
        near_dedup.linked = lambda *a, **k: whole(*a, **k, cell=3000)
        assert by_id(near_duplicates(df, words=2), "n_shingles", "component_id", "kept") == want
    finally:
        near_dedup.linked = whole


def test_long_words_are_told_apart(spark):
    """The two Thue-Morse words over a and b of 1,024 bytes, which polynomial hashes confuse."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert by_id(near_duplicates(df, words=2), "component_id") == {1: (1,), 2: (2,)}
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substring_dedup(df), "n_words", "n_removed", "kept_sha256") == brute.word_repeats(rows)


def test_recall_of_the_bands_at_the_threshold():
    """Pairs of similarity 0.8 exactly that share no band, in sets large and small."""
    from latticework.llm.line_dedup import BANDS, ROWS
    from latticework.llm.minhash import band_keys, wide_band_keys

    r = np.random.default_rng(7)
    for shared, every in ((80, 100), (40, 50), (20, 25), (8, 10), (4, 5)):
        own = (every - shared) // 2 + (every - shared) % 2
        pairs = 4000
        x = r.integers(0, (1 << 64) - 1, (pairs, every), dtype=np.uint64)
        sides = x[:, : every - own], np.concatenate([x[:, :shared], x[:, every - own :]], axis=1)
        for keys in (band_keys, lambda x, at: wide_band_keys(x, at, BANDS, ROWS)):
            a, b = (keys(s.ravel(), np.arange(pairs) * s.shape[1]) for s in sides)
            assert (a == b).any(axis=1).sum() >= pairs - 1
