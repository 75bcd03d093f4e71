"""The shards of the substring operators, run in this process."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from latticework.llm import repeats
from latticework.llm.fm_index import FMIndex
from latticework.llm.substring_dedup import RULE as WORDS
from latticework.llm.suffix_dedup import RULE as BYTES


def removed(rule, docs, hot_all):
    """Units covered by repeats, by document, as the Spark plan computes them."""
    shards, buckets = 3, 2
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.binary())], ["id", "bytes"])
    asked = pa.Table.from_batches([b for part in (batch.slice(0, 9), batch.slice(9)) for b in repeats._asked(rule, shards, buckets)([part])])
    answers = []
    for s in range(shards):
        own = asked.filter(pc.equal(asked["shard"], s))
        if own.num_rows:
            answers.append(repeats._answered(buckets)(own))
    answers = pa.concat_tables(answers)
    known = pa.concat_tables([asked.filter(pc.less(asked["shard"], 0)).select(["id", "blob"]), answers.filter(pc.is_null(answers["hot_key"])).select(["id", "blob"])])

    def by_id(table):
        out = {}
        for k in range(buckets):
            part = table.filter(pc.equal(table["id"], k))
            if part.num_rows:
                out |= {r["id"]: [r["blob"]] for r in repeats._by_id(part).to_pylist()}
        return out

    flags = by_id(known)
    hot = np.empty(0, np.uint64)
    if hot_all:
        hot = np.unique(np.concatenate([repeats.anchors(rule.codes(rule.units(t)), rule.window, rule.gram)[1] for _, t in docs]))
    some = [(d, t) for d, t in docs if d in flags]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.binary()), pa.array([flags[d] for d, _ in part], pa.list_(pa.binary()))], ["id", "bytes", "flags"])
        for part in (some[::2], some[1::2])
    ]
    runs = pa.Table.from_batches([b for x in batches for b in repeats._runs(rule, shards, hot)([x])])
    owned = by_id(pa.concat_tables([repeats._owners(rule, buckets)(runs.filter(pc.equal(runs["shard"], s))) for s in range(shards) if s in runs["shard"].to_pylist()]))
    return {d: repeats.covered(rule, t, flags.get(d), owned.get(d))[1] for d, t in docs}


def expected(rule, docs):
    first, out = {}, {}
    for d, t in docs:
        units = rule.units(t)
        gone = np.zeros(len(units), bool)
        for i in range(len(units) - rule.window + 1):
            key = units[i : i + rule.window].tobytes()
            at = first.setdefault(key, (d, i))
            if at[0] != d if rule.whole_document else at != (d, i):
                gone[i : i + rule.window] = True
        out[d] = gone
    return out


@pytest.mark.parametrize("hot_all", (False, True))
@pytest.mark.parametrize("rule", (BYTES, WORDS), ids=("bytes", "words"))
def test_repeats_with_and_without_hot_anchors(rule, hot_all):
    r = random.Random(6)
    pool = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(60)]
    line = " ".join(r.choice(pool) for _ in range(30))
    docs = []
    for d in range(24):
        parts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 40)))]
        if d % 2:
            parts.append(line)
        if d % 5 == 4:
            parts.append(docs[d - 3][1].decode())
        if d % 7 == 6:
            parts += [line, line]
        docs.append((d, " ".join(parts).encode()))
    got, want = removed(rule, docs, hot_all), expected(rule, docs)
    assert any(x.any() for x in want.values())
    for d in want:
        assert (got[d] == want[d]).all(), d


def test_matching_statistics():
    r = np.random.default_rng(4)
    text = r.integers(1, 4, 300)
    text[::50] = 0
    text[-1] = 0
    ends = np.array([i + 7 for i in range(290) if 0 not in text[i : i + 7]])
    length, begin = FMIndex(text).matches(text, ends, 7)
    shared = {}
    for e, n, at in zip(ends, length, begin):
        want = max(k for k in range(8) if k == 0 or sum((text[i : i + k] == text[e - k : e]).all() for i in range(300 - k + 1)) > 1)
        assert n == want
        if n == 7:
            assert shared.setdefault(int(at), text[e - 7 : e].tobytes()) == text[e - 7 : e].tobytes()
    assert len(shared) == len(set(shared.values())) > 10


def test_long_runs_are_told_apart():
    """Runs that polynomial hashes modulo powers of two confuse."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    docs = [(1, one.encode()), (2, one.translate(str.maketrans("ab", "ba")).encode())]
    got, want = removed(BYTES, docs, False), expected(BYTES, docs)
    assert all((got[d] == want[d]).all() for d in want)


@pytest.mark.parametrize("hot_all", (False, True))
@pytest.mark.parametrize("rule", (BYTES, WORDS), ids=("bytes", "words"))
def test_runs_of_one_owner_are_not_indexed(rule, hot_all):
    """Copies leave one run for each anchor; a gram that others have, too, is no dispute unless windows may be equal."""
    r = random.Random(7)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    docs = [(d, text.encode()) for d in (1, 2, 3)] + [(4, b"short")]
    got, want = removed(replace(rule, first=None), docs, hot_all), expected(rule, docs)
    assert want[2].all() and not want[1].any()
    assert all((got[d] == want[d]).all() for d in want)


def test_contested_runs():
    keys, docs, windows = (np.array(x) for x in ([5, 5, 6, 6, 7, 8, 8], [1, 2, 3, 3, 4, 5, 6], [3, 1, 2, 2, 9, 1, 1]))
    assert repeats.contested(BYTES, keys, docs, windows).tolist() == [True, True, False, False, False, False, False]
    assert repeats.contested(WORDS, keys, docs, windows).tolist() == [True, True, True, True, False, False, False]


def test_packing_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.empty(0, np.int32), np.array([1, 2], np.uint8)]
    for a, b in zip(arrays, repeats.unsqueeze(repeats.squeeze(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
