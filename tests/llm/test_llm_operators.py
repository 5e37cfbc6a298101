"""Brute force, edge cases and exact round trips of the ten operators."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import chat, common, components, decontam, minhash, packing, quality, queries, sharding, suffix, toxicity, urlfilter, warc

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "é" * 300), (6, "word " * 40000), (7, "same text here"), (7, "same text here"), (None, "no id at all")]


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1 packing


def test_packing_round_trip(spark, docs, real):
    files = queries.tokenizer_files()
    table = docs(ODD).unionByName(real.select("doc_id", "text").limit(60), allowMissingColumns=True)
    got = packing.pack_documents(table, **files, with_ids=True, block_tokens=20_000).collect()
    slow = packing.Encoder(files["tokenizer"])
    want = collections.Counter((i, (*slow.ids(t or "").tolist(), 1)) for i, t in rows_of(table, "doc_id", "text"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, own in pieces.items():  # repeated rows have each piece as often as the row
        copies = sum(n for (i, _), n in want.items() if i == k)
        if copies == 1:
            ids = [x for r in sorted(own, key=lambda r: r["start"]) for x in r["ids"]]
            assert (k, tuple(ids)) in want and own[0]["doc_tokens"] == len(ids)
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == own[0]["sequence_tokens"]  # no padding
    assert packing.pack_documents(docs([]), **files).count() == 0


def test_packing_plan_and_groups():
    rnd = random.Random(2)
    lengths = [rnd.choice([1, 3, 100, 256, 700, 2048, 5000, rnd.randint(1, 4000)]) for _ in range(400)]
    plan = packing.plan(lengths)
    covered = collections.defaultdict(list)
    for tier, part in plan:
        assert 0 < sum(p[0] for p in part) <= tier
        for n, doc, at in part:
            covered[doc].append((at, n))
    for doc, n in enumerate(lengths):
        ends = [0]
        for at, size in sorted(covered[doc]):
            assert at == ends[-1]
            ends.append(at + size)
        assert ends[-1] == n
    groups = packing.step_groups(plan, 16)
    cost = collections.Counter()
    for (tier, part), g in zip(plan, groups, strict=True):
        cost[tier, g] += sum(p[0] ** 2 for p in part)
    assert max(collections.Counter(groups).values()) <= 16
    assert all(len({t for (t, _), h in zip(plan, groups, strict=True) if h == g}) == 1 for g in set(groups))


def test_both_tokenizers_agree(real):
    files = queries.tokenizer_files()
    fast, slow = packing.Encoder(**{"path": files["tokenizer"], "ranks": files["ranks"], "pattern": files["pattern"]}), packing.Encoder(files["tokenizer"])
    texts = [t for (t,) in rows_of(real, "text")] + ["<|endoftext|> x", "a\u00a0b\u2003c  ", "\x85\x1c", "日本語 ½²ǅʰ ɏɐ", "don't WE'LL 's", "x" * 3000, " \t\n \r\n  a"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(files["tokenizer"])
    rnd = random.Random(59)
    every = [chr(c) for c in range(0x250) if packing.PLAIN.fullmatch(chr(c))]
    texts += ["".join(every), " ".join(every), *(f"a{c}b {c}{c} {c}1" for c in every), *("".join(rnd.choices(every + [" ", "'", "s", "\n"] * 20, k=60)) for _ in range(400)), "a <|endoftext|> b"]
    for t in texts:
        assert fast.ids(t).tolist() == slow.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert fast.ids("a <|endoftext|> b").tolist() != fast.fast.encode_ordinary("a <|endoftext|> b")


# 2 decontamination


def test_leaks_survive_substitution(spark, docs):
    rnd = random.Random(4)
    item = [f"w{rnd.randrange(10**6)}" for _ in range(30)]
    noise = lambda n: [f"n{rnd.randrange(10**6)}" for _ in range(n)]
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    table = docs([(1, " ".join(noise(50) + item + noise(9))), (2, " ".join(noise(5) + changed).upper() + "!!"), (3, " ".join(noise(80))), (4, " ".join(item[:8] + noise(40))), (5, None), (6, ""), (None, " ".join(item)), (1, " ".join(item))])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, "")], "item_id long, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = {r[0]: r[1:] for r in decontam.contaminated(table, bench, broadcast_bytes=limit).collect()}
        assert set(got) == {1, 2, None}
        assert got[1] == (7, 0, 30, 30)  # of two rows with one id the first place
        assert got[2][0] == 7 and got[2][2] == 26
    assert decontam.contaminated(table.limit(0), bench).count() == decontam.contaminated(table, bench.limit(0)).count() == 0
    left = decontam.without_contaminated(table, bench)
    assert sorted(r[0] for r in left.where("doc_id is not null").select("doc_id").collect()) == [3, 4, 5, 6] and left.columns == table.columns


def test_leaks_are_the_same_whatever_the_benchmarks_size(spark, docs):
    rnd = random.Random(14)
    noise = lambda n: [f"n{rnd.randrange(10**6)}" for _ in range(n)]
    item, other, long = noise(40), noise(24), ["same"] * 200
    half = [w if k % 2 else f"x{k}" for k, w in enumerate(item)]
    rows = [(1, item[:11] + noise(50)), (1, half), (2, noise(20000) + item + noise(20000)), (3, item + noise(5) + other), (3, other), (4, ["same"] * 3000), (None, other), (None, noise(9) + other), (5, noise(12)), (5, noise(30))]
    table = docs([(i, " ".join(t)) for i, t in rows] + [(6, None), (6, ""), (2, None)])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (8, " ".join(noise(24))), (9, " ".join(long)), (None, " ".join(item)), (7, " ".join(item))], "item_id long, text string")
    got = [sorted(map(str, decontam.contaminated(table, bench, broadcast_bytes=limit).collect())) for limit in (decontam.BROADCAST_BYTES, 0)]
    assert got[0] == got[1]
    found = {(r["doc_id"], r["item_id"]): (r["place"], r["matched"], r["item_tokens"]) for r in decontam.contaminated(table, bench).collect()}
    want = {(2, 7): (20000, 40, 40), (3, 7): (0, 40, 40), (3, 8): (0, 24, 24), (None, 8): (0, 24, 24), (4, 9): (0, 200, 200), (1, 7): (0, 11, 40)}
    assert found == want | {(i, None): want[i, 7] for i in (1, 2, 3)}


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_leaks_of_less_than_half_an_item(spark, docs, limit):
    rnd = random.Random(5)
    noise = lambda n: [f"n{rnd.randrange(10**6)}" for _ in range(n)]
    long, middle, short = noise(300), noise(60), noise(30)
    cases = {
        1: noise(20) + long[90:230] + noise(20),  # a verbatim run
        2: noise(9) + middle[:28],  # split over two documents
        3: middle[32:] + noise(9),
        4: noise(7) + short[:10] + noise(1) + short[10:20] + noise(2) + short[20:] + noise(5),  # inserted
        5: noise(40) + short[:10] + short[11:20] + short[21:],  # deleted
        6: noise(33) + long[40:46] + noise(1) + long[47:53] + noise(30),  # one substitution in 13
        7: noise(3) + long[20:33],
        8: long[:10] + noise(30) + long[150:160],  # below the window, pieces below half
        9: noise(4) + middle[:10] + noise(60),
        10: short[:10] + noise(400) + short[20:],  # pieces far apart
    }
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(middle)), (3, " ".join(short))], "item_id long, text string")
    found = decontam.contaminated(docs([(i, " ".join(t)) for i, t in cases.items()]), bench, broadcast_bytes=limit)
    got = {r["doc_id"]: (r["item_id"], r["place"], r["matched"]) for r in found.collect()}
    assert got == {1: (1, -70, 140), 2: (2, 9, 28), 3: (2, -32, 28), 4: (3, 7, 30), 5: (3, 40, 28), 6: (1, -7, 12), 7: (1, -17, 13)}


# 3 toxicity


def toxic_table(n=1200):
    """Labelled texts of one make, a fifth of them with a few telling words."""
    rnd = random.Random(6)
    bad, words = ["vile", "awful", "horrid"], [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "ero", "il", "und", "ots")]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        text = [rnd.choice(words) + rnd.choice(["", "s"]) for _ in range(rnd.randint(20, 60))]
        for _ in range(4 * toxic):
            text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark, docs):
    rows, labels = toxic_table()
    truth = dict(labels)
    label_table = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    long = " ".join(t for _, t in rows)
    table = docs([*rows, (9001, None), (9002, ""), (None, "x"), (9003, long), (9004, long), rows[0], rows[0]])
    every = toxicity.toxicity(table, label_table).collect()
    got = {r["doc_id"]: r for r in every}
    assert len(every) == 1207 and all(0 <= r["score"] <= 1 for r in every)
    assert len({r["score"] for r in every if r["doc_id"] == 0}) == 1 and got[9003]["score"] == got[9004]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    test = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in test]) > 0.95
    assert toxicity.toxicity(docs([]), label_table).count() == 0
    none = toxicity.toxicity(docs([(1, "a")]), label_table.limit(0)).first()
    assert 0 <= none["score"] <= 1


def test_toxicity_matches_a_plain_version(spark, docs):
    """Dictionaries, distances, coefficients and scores once more, without Spark."""
    import zstandard

    rows, labels = toxic_table(600)
    rows += [(2000 + k, rows[k][1]) for k in range(40)]  # copies are no evidence
    labels += [(2000 + k, labels[k][1]) for k in range(40)]
    truth = dict(labels)
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in truth}
    own = {i: t.split() for i, t in rows}
    mark = {i: min(zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(len(w) - 2)) for i, w in own.items()}
    one = {}
    for i in sorted(own, reverse=True):
        if fold[i] < 2:
            one[mark[i], truth[i]] = i
    learn = sorted(one.values())
    n, bad = collections.Counter(), collections.Counter()
    for i in learn:
        n.update(set(own[i]))
        bad.update(set(own[i]) if truth[i] else ())
    p = sum(truth[i] for i in learn) / len(learn)
    z = {w: (bad[w] - n[w] * p) / (n[w] * p * (1 - p)) ** 0.5 for w in n}
    telling = {w: x for w, x in z.items() if x > toxicity.TOXIC_Z and bad[w] > 1}
    assert set(telling) == {"vile", "awful", "horrid"}
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(model.toxic.count(w.encode()) > 0 == model.ordinary.count(w.encode()) for w in telling)
    passages = {" ".join(own[i][k : k + 8]) for i in learn for k in range(0, len(own[i]), 8)}
    assert len(model.toxic) == len(model.ordinary)
    told = model.toxic.decode().split()
    assert sum(" ".join(told[k : k + 8]) in passages for k in range(len(told) - 8)) > len(told) / 10  # texts, not lists

    def lengths(content, parts):
        data = toxicity.CLOSING + content + toxicity.PREAMBLE
        params = zstandard.ZstdCompressionParameters.from_level(9, source_size=200, dict_size=len(data), write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return np.array([len(c.compress(toxicity.PREAMBLE + b" " + x.encode() + b" " + toxicity.CLOSING)) for x in parts])

    def numbers(words):
        parts = [" ".join(words[k : k + 8]) for k in range(0, max(1, len(words) - 4), 4)]
        d = np.clip(lengths(model.ordinary, parts) - lengths(model.toxic, parts), -24, 24)
        return [*[np.log1p((d >= t).sum()) for t in toxicity.THRESHOLDS], np.log1p(len(parts)), 1.0]

    x = np.array([numbers(own[i]) for i in own if fold[i] == 3])
    y = np.array([truth[i] for i in own if fold[i] == 3])
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ model.beta))) - np.array([0.3] * 6 + [1e-6]) * model.beta
    assert np.abs(gradient).max() < 1e-4  # the penalised likelihood's maximum
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i in list(own)[::7]:
        assert abs(got[i] - 1 / (1 + np.exp(-np.array(numbers(own[i])) @ model.beta))) < 1e-9


def test_held_out_labels_are_never_read(spark, docs):
    rows = [(i, "good plain words here" if i % 3 else "vile thing " * 3) for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [rows_of(toxicity.toxicity(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id"), "score") for x in (labels, turned)]
    assert scores[0] == scores[1]


# 4 suffix dedup


def brute_repeats(texts, size):
    starts = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size", [64, 100, 400])
def test_repeats_match_brute_force(spark, docs, size):
    rnd = random.Random(size)
    base = "".join(rnd.choice("ab cé") for _ in range(1500))
    near = "".join(c if rnd.random() > 0.01 else "z" for c in base)
    rows = [*ODD[:5], (8, "word " * 500), (9, base), (9, base[:900]), (10, near), (11, base[300:1100] + "tail"), (12, "x" * 900), (13, "x" * 450), (14, "ab" * 700), (7, "same text here"), (15, base), (None, base[200:800])]
    rows += [(100 + k, "".join(rnd.choice("abcdef ") for _ in range(300)) + base[k * 40 : k * 40 + 430]) for k in range(20)]
    rows += [(15, base)]
    got = suffix.text_columns(suffix.find_repeats(docs(rows), size)).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], size)
    assert collections.Counter((r["doc_id"], *tuple(r)[1:5]) for r in got) == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_frequent_prefixes_are_dealt_apart(docs, monkeypatch):
    rnd = random.Random(31)
    noise = lambda n: "".join(rnd.choice("abcdef ") for _ in range(n))
    common = noise(260)
    rows = [(k, noise(150) + common + noise(150)) for k in range(60)] + [(100 + k, "x" + common + "y" * 90) for k in range(30)]
    rows += [(None, noise(90) + common + noise(20)) for _ in range(5)] + [(7, noise(300)), (7, common)]
    monkeypatch.setattr(suffix, "SAMPLED", 1)
    monkeypatch.setattr(suffix, "STRINGS_AT_ONCE", 500)
    plain = docs(rows).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    assert len(suffix.frequent_prefixes(plain, 200, 4)) > 0
    got = suffix.text_columns(suffix.find_repeats(docs(rows), 200)).collect()
    want = brute_repeats([t.encode() for _, t in rows], 200)
    assert collections.Counter((r["doc_id"], *tuple(r)[1:5]) for r in got) == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert all(len(r["text"].encode()) == r["n_bytes"] - r["n_removed"] for r in got)


def test_repeats_keep_other_columns_and_whole_characters(docs):
    text = "é" * 60
    got = suffix.find_repeats(docs([(1, "a" + text), (2, "è" + text)]), 64, whole_characters=True).collect()
    assert all(bytes(r["kept"]).decode() in ("a", "è") and r["extra"]["lang"] == "en" for r in got)
    assert suffix.find_repeats(docs([]), 64).count() == 0
    with pytest.raises(ValueError):
        suffix.find_repeats(docs([]), 10)


# 5 chat


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "ho"), (4, 1, None, None), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (5, 1, "assistant", "no"), (None, 0, "user", "hi"), (6, None, "user", "x")]
    turns += [(7, k, "user", f"long {k}") for k in range(300)] + [(8, k, "user", f"long {k}") for k in range(130)]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    got = rows_of(chat.rendered(table).orderBy("conv_id", "part"), "conv_id", "part", "n_turns")
    assert sorted({c for c, _, _ in got}) == [2, 4, 5, 6, 7]  # 1 and 8 begin others, 3 equals 2
    assert [n for c, _, n in got if c == 7] == [64, 64, 64, 64, 44] and dict((c, n) for c, _, n in got)[5] == 2
    text = "".join(r[0] for r in chat.rendered(table).where("conv_id = 2").select("rendered").collect())
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert chat.rendered(table.limit(0)).count() == 0


def test_turns_of_one_number_and_long_turns(spark):
    rnd = random.Random(29)
    same = [(1, None, "user", f"t{k}") for k in range(1000)] + [(2, 5, "user", f"t{k}") for k in range(700)] + [(2, 5, "user", "t1")] * 50
    long = [(3, 0, "user", "hi"), (3, 1, "assistant", "x" * 300_000), (4, 0, "user", "hi"), (4, 1, "assistant", "x" * 300_000), (4, 2, "user", "more")]
    rnd.shuffle(same)
    table = spark.createDataFrame(same + long, "conv_id long, turn long, role string, text string")
    got = chat.rendered(table).collect()
    for conv, n in ((1, 1000), (2, 700)):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["part"])
        assert [r["n_turns"] for r in own] == [64] * (n // 64) + [n % 64] and [r["part"] for r in own] == list(range(len(own)))
        texts = re.findall(r"user\n(t[0-9]+)<", "".join(r["rendered"] for r in own))
        assert sorted(texts) == sorted({t for c, _, _, t in same if c == conv})
    assert {r["conv_id"] for r in got} == {1, 2, 4}
    assert next(r for r in got if r["conv_id"] == 4)["n_chars"] > 300_000


# 6 sharding


def shards_of(got):
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_shards_are_even(spark, docs):
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randint(0, 400)) for i in range(3000)] + [(i, "hot " * 20) for i in range(3000, 4500)] + ODD[:5] + ODD[6:]
    got = sharding.kd_shards(docs(rows), n_shards=13).collect()
    size = shards_of(got)
    mean = sum(size.values()) / 13
    assert len(got) == len(rows) and set(size) == set(range(13)) and max(abs(s - mean) for s in size.values()) < 0.05 * mean
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.kd_shards(docs([]), n_shards=4).count() == 0
    assert len({r["shard"] for r in sharding.kd_shards(docs(rows[:500]), target_bytes=20_000).collect()}) > 2


def test_rows_heavier_than_a_shard(docs):
    size = shards_of(sharding.kd_shards(docs(ODD), n_shards=4).collect())  # one text of 200 KB
    assert max(size.values()) == 200_016 and sum(size.values()) == sum(len((t or "").encode()) + 16 for _, t in ODD)
    assert 1 < len(size) <= 4
    same = shards_of(sharding.kd_shards(docs([(5, "one text " * 9)] * 700 + [(6, "two")]), n_shards=5).collect())  # repeated rows
    mean = sum(same.values()) / 5
    assert len(same) == 5 and all(abs(s - mean) < 0.25 * mean for s in same.values())


def test_equal_texts_stay_together(spark, docs):
    rnd = random.Random(17)
    rows = [(i, f"text {rnd.randrange(300)} " * 5) for i in range(900)]
    table = docs(rows).drop("lang").withColumn("lang", F.concat(F.lit("seven bytes alike "), (F.col("doc_id") % 3).cast("string")))
    shards = collections.defaultdict(set)
    got = sharding.kd_shards(table, n_shards=6).collect()
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    mean = sum(shards_of(got).values()) / 6
    assert all(abs(s - mean) < 0.05 * mean for s in shards_of(got).values())


def plain_tree(units, n, first, dims, spread):
    """Shards by a k-d tree over units (size, hash, coordinates), in plain Python."""
    if n == 1 or not units:
        return {h: first for _, h, _ in units}
    reach = [max(u[2][k] for u in units) - min(u[2][k] for u in units) for k in range(dims)]
    k = max(range(dims), key=lambda k: reach[k] / spread[k])
    goal, half = sum(u[0] for u in units) * (n // 2) / n, n // 2
    values = sorted({u[2][k] for u in units})
    before = 0
    for at in values:
        tied = sorted((h, s) for s, h, c in units if c[k] == at)
        if before + sum(s for _, s in tied) >= goal:
            break
        before += sum(s for _, s in tied)
    over = before + sum(s for _, s in tied) - goal
    left = {h for _, h, c in units if c[k] < at}
    if over == 0:
        left |= {h for h, _ in tied}
    elif before < goal:
        for h, s in tied:
            if before + s >= goal:
                left |= {h} if before + s - goal < goal - before else set()
                break
            left.add(h)
            before += s
    out = plain_tree([u for u in units if u[1] in left], half, first, dims, spread)
    return out | plain_tree([u for u in units if u[1] not in left], n - half, first + half, dims, spread)


def test_shards_match_a_plain_tree(spark, docs):
    rnd = random.Random(19)
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 90)))) for i in range(400)]
    table = docs(rows).drop("lang", "source").withColumn("lang", F.element_at(F.array(*map(F.lit, ["de", "en", None, "fr"])), (F.col("doc_id") % 4 + 1).cast("int"))).withColumn("source", (F.col("doc_id") % 7).cast("double") / 2)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(table, n_shards=11, tolerance=0.0, large_units=0).collect()}
    th = {r[0]: r[1] for r in table.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.encode("text", "UTF-8")), 1)).collect()}
    lang, groups = {None: 1, "de": 2, "en": 3, "fr": 4}, {}
    for r in table.collect():
        c = (lang[r["lang"]], int(r["source"] * 2) + 1)
        size = len(r["text"]) + 16
        s, _, old = groups.get(th[r["doc_id"]], (0, 0, (size, 99, 99)))
        groups[th[r["doc_id"]]] = (s + size, th[r["doc_id"]], (size, min(old[1], c[0]), min(old[2], c[1])))
    units = list(groups.values())
    spread = [max(u[2][k] for u in units) - min(u[2][k] for u in units) for k in range(3)]
    want = plain_tree(units, 11, 0, 3, spread)
    assert got == {i: want[h] for i, h in th.items()}


# 7 near duplicates


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x = len(sets[a] & sets[b])
                if x and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x) and least[b] < least[a]:
                    least[a] = least[b]
                    changed = True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize(("block_bytes", "block_classes"), [(minhash.BLOCK_BYTES, 512), (4000, 512), (minhash.BLOCK_BYTES, 3)])
def test_near_duplicates_match_brute_force(docs, block_bytes, block_classes):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(300))
    bases = [[word() for _ in range(rnd.randint(30, 120))] for _ in range(6)]
    rows = [(i, t) for i, t in ODD if i not in (7, None)]
    for k in range(160):
        base = list(bases[k % 6])
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            base[rnd.randrange(len(base))] = word()
        rows.append((100 + k, " ".join(base) if k % 7 else " ".join(base).upper()))
    rows += [(500 + k, " ".join(word() for _ in range(40))) for k in range(60)] + [(600, "A b c d e"), (601, "a b c d e"), (602, "a b c d f"), (603, "tiny one"), (604, "TINY  one")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows), block_bytes=block_bytes, block_classes=block_classes).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_odd_rows(docs):
    got = rows_of(minhash.near_duplicates(docs(ODD)), "doc_id", "component_id", "kept")
    assert len(got) == len(ODD) and got.count((7, 7, True)) == 2 and (None, None, True) in got
    assert minhash.near_duplicates(docs([])).count() == 0


def test_components_of_links(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    least = {n: n for p in links for n in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(links, "u long, v long"), common.Scratch(spark, "t"), "c")
    found = dict(rows_of(got, "node", "component"))
    assert {n: found.get(n, n) for n in least} == least
    assert components.components(spark.createDataFrame([], "u long, v long"), common.Scratch(spark, "t"), "c").count() == 0


# 8 quality


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_matches_brute_force(spark, docs, real, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    extra = ODD + [(20, "a b c a b c"), (21, "a b c d a b c\n\na b c d a b c\n \nx"), (22, "\x0b\x0ca\u00a0b #|<"), (23, "k " * 3)]
    table = docs(extra).unionByName(real.select("doc_id", "text"), allowMissingColumns=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = collections.Counter(rows_of(quality.quality_rules(table, labels), "doc_id", *names))
    assert got == collections.Counter((i, *brute_quality(t)) for i, t in rows_of(table, "doc_id", "text"))
    none = quality.quality_rules(real, labels.limit(0))
    assert none.where("score <> 0 or kept = base_failed").count() == 0 and quality.quality_rules(docs([]), labels).count() == 0


def test_quality_score_by_hand(spark, docs):
    import xxhash

    rows = [(1, "alpha beta gamma " * 20), (2, "alpha delta " * 30), (3, "%% ## " * 30)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))

    def pair(a, b):
        """The hash of two longs, the first one's hash seeding the second's."""
        h = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        return signed(h if b is None else xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), h))

    grams = {i: [x % quality.BUCKETS for a, b in zip(h, [*h[1:], None], strict=True) for x in (a, pair(a, b))] for i, h in ((i, [one(w) for w in t.split()]) for i, t in rows)}
    raw, good = collections.Counter(x for g in grams.values() for x in g), collections.Counter(grams[1])
    share, s = sum(good.values()) / sum(raw.values()), quality.SMOOTHING
    for r in quality.quality_rules(docs(rows), labels).collect():
        want = np.mean([np.log((good[x] + s) / (raw[x] * share + s)) for x in grams[r["doc_id"]]])
        assert abs(r["score"] - want) < 1e-9


# 9 urls


def test_urls_match_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "xexample.net", "example.com", "b.a.example.com", "org", "f.org", "", "u@h:80", "NET", "de.example.com."]
    paths = ["", "/", "/en/", "/en/x?q#f", "/de/1", "/fr/#x", "/frx", "?a=/en/", "#t"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "x://", "a://b://c/en/"] + ["http://hot.example.net/en/1"] * 300
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [*urlfilter.RULES, ("example.net", "/en/x", "block"), ("a.example.net", "/", "block"), ("net", "/", "allow"), (None, "/", "block")]
    table = spark.createDataFrame(rules, "host string, path string, action string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fit = [(len(h), len(p), a == "block", h + p, a) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return (host, path, best[3] if best else None, best[4] if best else "allow")

    for cells in (1, 3, 40):
        got = urlfilter.judged(pages, table, cells)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: brute(u) for k, u in enumerate(urls)}
    assert urlfilter.judged(pages.limit(0), table).count() == 0
    assert urlfilter.judged(pages, table.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


# 10 archives


def test_arc_versions_parse():
    body = b"<p>\r\n\r\nWARC/1.0 \xff"
    for version in (1, 2):
        data = warc.arc_header(version) + b"".join(warc.arc_record(version, k, u, body * k) for k, u in ((1, "http://a/ b"), (2, None), (3, "x://y")))
        found = list(warc.parse_arc(data))
        assert [f["url"] for f in found] == ["http://a/%20b", "-", "x://y"]
        assert [warc.http_parts(f["document"])[1] for f in found] == [body, body * 2, body * 3]
        with pytest.raises(ValueError, match="cut off"):
            list(warc.parse_arc(data[:-5]))
        with pytest.raises(ValueError, match="damaged"):
            list(warc.parse_arc(data.replace(b"x://y 0.0.0.0", b"x://y")))
    assert list(warc.parse_arc(b"")) == []
    with pytest.raises(ValueError, match="byte 0"):
        list(warc.parse_arc(b"what is this\n"))


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rnd = random.Random(23)
    noise = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"http://a/{k}", noise(rnd.choice([0, 300, 30_000]))) for k in range(300)] + [(900, "http://big/", noise(6_000_000)), (901, "http://odd/", "<p>\x1f\x8b\u0000</p>" * 9)]
    records = warc.arc_records(warc.arc_segments(spark.createDataFrame(rows, "page_id long, url string, html string")))
    warc.write_warc(warc.warc_records(records, warc.revisits(records), piece_bytes=50_000), str(tmp_path / "w"), file_pieces=2)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert len(files) > 10 and sorted(len(f) for f in files)[-2] < 2 * 50_000 + 40_000
    assert sum(f.count(b"\x1f\x8b\x08\x00") for f in files) >= len(rows) and all(gzip.decompress(f).startswith(b"WARC/1.0") for f in files)
    got = {r["page_id"]: r["payload_digest"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {k: hashlib.sha256(h.encode()).hexdigest() for k, _, h in rows}


def test_pages_round_trip(spark, tmp_path):
    big = "<p>équal</p>" * 20
    rows = [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "n", None), (6, "e", ""), (7, "w", "WARC/1.0\r\n\r\n" * 30), (8, "w", "x\r\n\r\n"), (None, "z", big), (9, "again", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "archives")
    got = warc.convert_pages(pages, f"file://{path}").collect()
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == collections.Counter([(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (9, "revisit", 3), (None, "response", None), *((k, "response", None) for k in (1, 2, 4, 6, 7, 8))])
    want = {i: ((h or "").encode()) for i, _, h in rows}
    assert all(r["payload_bytes"] == len(want[r["page_id"]]) and r["payload_digest"] == hashlib.sha256(want[r["page_id"]]).hexdigest() for r in got)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("part-*"))
    records = list(warc.parse_warc(data))
    assert len(records) == len(rows) and all(h["warc-date"] == "2020-01-01T00:00:00Z" and h["warc-record-id"].startswith("<urn:uuid:") for h, _ in records)
    assert data.count(b"\r\n\r\n") >= 2 * len(rows)
    assert warc.convert_pages(pages.limit(0), f"file://{path}-none").count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = common.smallest_hashes(df, 100, "doc_id")
    want = df.orderBy(F.xxhash64("doc_id")).limit(100)
    assert sorted(rows_of(got, "doc_id")) == sorted(rows_of(want, "doc_id"))
