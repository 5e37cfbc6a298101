"""The registered queries against their SQL, and the pipeline against brute force."""

import collections
import importlib.util
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm_operators import brute_near, brute_quality

from foliograph.llm import decontam, packing, quality, queries

ROOT = Path(__file__).resolve().parents[2]
spec = importlib.util.spec_from_file_location("compare", ROOT / "tests/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    compare.assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], sf_dir)


def test_pipeline_stages(spark, sf_dir):
    sys.path.insert(0, str(ROOT))
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, state = docs.columns, docs
    from foliograph.llm.common import Scratch

    scratch, sizes = Scratch(spark, "stages"), [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        state = scratch.save(stage(spark, state, sf_dir), name)
        assert state.columns == columns and state.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        sizes.append(state.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 0
    assert state.where("text like '%\ufffd%'").count() == 0 and state.where("n_chars <> length(text)").count() == 0
    pieces = cp.run(spark, sf_dir)
    ids = {r[0] for r in state.select("doc_id").collect()}
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == ids


def test_pipeline_takes_empty_tables_and_nulls(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).unionByName(docs.limit(30).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(5)).unionByName(docs.limit(5)).unionByName(docs.limit(1).selectExpr("999999L doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    for state in (docs.limit(0), odd):
        for _, stage in cp.STAGES:
            state = stage(spark, state, sf_dir)
            state.count()


def test_rows_count_by_id_and_text(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(21)
    noise = lambda n: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(n))
    a, b, c, d, item = noise(90), noise(90), noise(90), noise(90), noise(30)
    leak = f"{noise(20)} {item} {noise(20)}"
    rows = [(7, a), (7, b), (7, b), (8, a), (None, a), (None, c), (None, c), (9, d), (9, leak), (None, f"{item} {noise(60)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = cp.near_dedup(spark, docs, sf_dir)
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in single.collect())) == sorted([(7, a), (7, b), (0, c), (9, d), (9, leak), (0, rows[-1][1])])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = cp.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean) == sorted((i or 0, t) for i, t in rows[:8])


def test_columns_of_any_name_come_through(spark, sf_dir):
    import corpus_pipeline as cp

    names = ["nth", "nth_", "row", "row_", "component_id", "hash", "own", "kept", "x", "part", "Text_Hash"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[-len(names) :] == names
    docs = docs.collect()
    assert docs and all(r[c] == f"{c}{r['doc_id']}" for r in docs for c in names)


def test_passages_of_short_words_are_cut(spark, sf_dir):
    import corpus_pipeline as cp

    rnd = random.Random(22)
    noise = lambda n: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(n))
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(2)) for _ in range(51))
    rows = [(k, f"{noise(20)} {passage} {noise(20)}", "en", "s", 0) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(passage) < 200 and not any(passage[20:-20] in r["text"] for r in cp.suffix_dedup(spark, docs, sf_dir).collect())


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def brute_scores(rows, trusted):
    """Mean log ratio of each row's grams, by whole Python counts."""
    grams = []
    for _, text in rows:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        first = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42) for a in h]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), f) for f, b in zip(first, h[1:], strict=False)] + first[-1:]
        grams.append([signed(x) % quality.BUCKETS for x in [*h, *pairs]])
    raw = collections.Counter(x for g in grams for x in g)
    good = collections.Counter(x for (i, _), g in zip(rows, grams, strict=True) if i in trusted for x in g)
    share, s = sum(good.values()) / sum(raw.values()), quality.SMOOTHING
    return [np.mean([np.log((good[x] + s) / (raw[x] * share + s)) for x in g]) if g else 0.0 for g in grams]


def brute_cut(texts, size):
    """The texts without the bytes of strings of this size that start twice or more."""
    texts = [t.encode() for t in texts]
    starts = collections.Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if starts[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g).decode())
    return out


def brute_leak(text, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    d = words(text)
    for item in map(words, items):
        for place in range(-len(item), len(d)):
            equal = [0 <= k + place < len(d) and d[k + place] == w for k, w in enumerate(item)]
            hit = any(all(equal[j + o] for o in m) for m in decontam.MASKS for j in range(len(item) - m[-1]))
            if hit and sum(equal) >= max(decontam.LEAST, decontam.SHARE * len(item)):
                return True
    return False


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(12)
    noise = lambda n: [f"{rnd.choice('bcdfgr')}a{rnd.randrange(5000)}" for _ in range(n)]
    bases = [noise(rnd.randint(90, 140)) for _ in range(40)]
    passage, item = noise(60), noise(30)
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    rows += [(100 + k, " ".join([*bases[k][:50], "other", *bases[k][51:]])) for k in range(10)]  # near copies
    rows += [(200 + k, rows[20 + k % 3][1]) for k in range(12)] + [rows[0], rows[0]]  # copies, repeated rows
    rows += [(300 + k, " ".join([*noise(70 + k), *passage, *noise(80)])) for k in range(6)]  # a shared passage
    rows += [(400, " ".join([*noise(70), *item, *noise(70)])), (401, " ".join([*noise(60), *[w if k % 9 else "x" for k, w in enumerate(item)]]))]  # leaks
    rows += [(500 + k, " ".join(f"jk{rnd.randrange(12)}" for _ in range(80))) for k in range(40)]  # the method's verdict
    rows += [(600, None), (601, ""), (602, "too short"), (603, "again and again " * 40), (None, " ".join(noise(80))), (700, "é" + " é".join(noise(3000)))]
    benchmark = [(1, " ".join(item)), (2, " ".join(noise(25))), (3, None)]
    trusted = {i for i in range(40) if i % 2}
    make = spark.createDataFrame
    make([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    make([*((i, 1, 0) for i in trusted), (500, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scores = brute_scores(rows, trusted)
    good = [r for r, x in zip(rows, scores, strict=True) if not brute_quality(r[1])[-1] and round(x, 9) >= quality.THRESHOLD]
    assert {i for i, _ in good}.isdisjoint(range(500, 604)) and len(good) > 60
    near = brute_near([r for r in good if r[0] is not None])
    single = [r for r in dict.fromkeys(good) if r[0] is None or near[r[0]][2]]
    assert len(single) == 50
    cut = list(zip([i for i, _ in single], brute_cut([t for _, t in single], cp.REPEAT_BYTES), strict=True))
    assert sum(a != b for a, b in zip(cut, single, strict=True)) == 6
    want = [(i, t) for i, t in cut if i is None or not brute_leak(t, [t for _, t in benchmark])]
    assert {i for i, _ in cut} - {i for i, _ in want} == {400, 401}

    encoder = packing.Encoder(queries.tokenizer_files()["tokenizer"])
    ids = {i: np.array([*encoder.ids(t).tolist(), 1], "<u4") for i, t in want}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in cp.run(spark, str(tmp_path)).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, total in [(pieces[i], len(x)) for i, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total else at <= 2048
