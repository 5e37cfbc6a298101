"""Golden cases of ranges, names, order, distances, formats, trees and graphs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import graph, latest, merkle, order, ranges, rename


def pages(spark, n):
    return spark.createDataFrame([(0, i) for i in range(1, n + 1)], "doc int, page int")


@pytest.mark.parametrize(("spec", "want"), [("1-3", [1, 2, 3]), ("2,4", [2, 4]), ("3-", [3, 4, 5]), ("-2", [1, 2]), ("odd", [1, 3, 5]), ("PARES", [2, 4]), ("rev", [5, 4, 3, 2, 1]), ("", [1, 2, 3, 4, 5]), ("5-100", [5]), ("2,2,1", [2, 2, 1]), ("-", [1, 2, 3, 4, 5])])
def test_range_selects(spark, spec, want):
    rows = ranges.select_range(pages(spark, 5), spec, ["doc"], ["page"]).orderBy("out_no").collect()
    assert [r["page"] for r in rows] == want
    assert [r["out_no"] for r in rows] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("spec", ["0", "x", "7-3", "1-y", ",,", "-0"])
def test_range_errors(spec):
    with pytest.raises(ValueError):
        ranges.parse_range(spec)


def test_range_beyond_the_rows(spark):
    assert ranges.select_range(pages(spark, 2), "5", ["doc"], ["page"]).count() == 0
    assert ranges.range_status(pages(spark, 2), "5", ["doc"]).first()["status"] == "Fail"
    with pytest.raises(Exception, match="row 5 does not exist"):
        ranges.select_range(pages(spark, 2), "5", ["doc"], ["page"], strict=True).collect()


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 3), ("force", "froce", 1), ("ABC", "abc", 0), ("ñandú", "nandu", 2), ("abc", "", 3), ("--list", "--lst", 1), ("ca", "abc", 3)])
def test_distance(a, b, want):
    assert T.osa_distance(a, b) == T.osa_distance(b, a) == want


def test_closest():
    names = ["--force", "--list", "--output"]
    assert T.closest("--froce", names) == "--force"
    assert T.closest("--xyzzy", names) == T.closest("a", []) == ""


def told(spark, make, values, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_format_bytes(spark):
    values = [0, 999, 1000, 38200, 211000, 999500, 9810000, 25000000, -38200, 3 * 10**12]
    assert told(spark, T.format_bytes, values, "long") == ["0 B", "999 B", "1,00 KB", "38,2 KB", "211 KB", "1,00 MB", "9,81 MB", "25,0 MB", "-38,2 KB", "3,00 TB"]


def test_format_numbers(spark):
    assert told(spark, lambda c: T.fixed(c, 1), [1234.5, -0.04, -12.5], "double") == ["1.234,5", "0,0", "-12,5"]
    assert told(spark, lambda c: T.grouped(c, "en"), [1234567], "long") == ["1,234,567"]
    assert told(spark, T.format_percent, [0.7512, float("nan"), None], "double") == ["75 %", "— %", "— %"]


def test_format_durations(spark):
    assert told(spark, T.format_duration, [0.0004, 0.412, 3.24, 187.0, 7980.0], "double") == ["0,40 ms", "412 ms", "3,24 s", "3 min 07 s", "2 h 13 min"]
    assert told(spark, T.format_clock, [187.0, 3849.0, -5.0], "double") == ["3:07", "1:04:09", "0:00"]
    assert told(spark, T.format_ago, [0.2, 9.4, 180000.0, None], "double") == ["recién", "hace 9 s", "hace 2 días", "—"]
    assert told(spark, lambda c: T.format_ago(c, "en", short=True), [7980.0], "double") == ["2 h ago"]
    assert told(spark, lambda c: T.format_rate(F.lit(84_200_000), c), [1.0, 0.0], "double") == ["84,2 MB/s", "—"]


def test_parse_words(spark):
    assert told(spark, T.parse_bool, ["sí", "OFF", "quizá", ""], "string") == [True, False, None, True]
    assert told(spark, T.is_number, ["1e3", "x"], "string") == [True, False]
    assert told(spark, T.text_bytes, ["abc", "é"], "string") == [b"abc", b"\xfe\xff\x00\xe9"]


def natural_less(a, b):
    """The ordering rules, spelled out."""

    def parts(s):
        out, k = [], 0
        while k < len(s):
            j = k
            while j < len(s) and s[j].isdigit():
                j += 1
            out.append(s[k:j] if j > k else s[k])
            k = max(j, k + 1)
        return out

    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    for x, y in zip(parts(low(a)), parts(low(b)), strict=False):
        if x[0].isdigit() and y[0].isdigit():
            if int(x) != int(y):
                return int(x) < int(y)
            if len(x) != len(y):
                return len(x) < len(y)
        elif x != y:
            return x[:1] < y[:1]
    la, lb = len(parts(low(a))), len(parts(low(b)))
    return la < lb if la != lb else a < b


def test_natural_order(spark):
    rnd = random.Random(5)
    names = ["foto2", "foto10", "Foto2", "img7", "img007", "x", "x1", "pag1", "pag2", "Pag3", "pag10", "9" * 20, "1" * 21, "", "a.b", "a-1"]
    names += ["".join(rnd.choice("aB01.9-") for _ in range(rnd.randint(1, 8))) for _ in range(150)]
    df = spark.createDataFrame([(n,) for n in set(names)], "name string").withColumn("key", order.natural_key(F.col("name")))
    got = [r["name"] for r in df.orderBy("key", "name").collect()]
    for a, b in zip(got, got[1:], strict=False):
        assert not natural_less(b, a), (a, b)


def test_rename(spark):
    assert rename.free_names([("a", 1), ("a", 2), ("a_2", 3), ("a", 1), ("a", 3)]) == ["a", "a_2", "a_2_2", "a", "a_3"]
    assert rename.with_suffix(b"\xfe\xff\x00a", "_2") == b"\xfe\xff\x00a\x00_\x002"
    rows = [(0, "a", 1), (1, "a", 2), (2, "a_2", 3), (3, "b", 3)]
    got = rename.rename_conflicts(spark.createDataFrame(rows, "k int, name string, owner int"), "name", "owner", "k")
    assert [r["new_name"] for r in got.orderBy("k").collect()] == ["a", "a_2", "a_2_2", "b"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 5), (2, 1, 1), (2, 1, 9)], "doc_id int, src long, dst long")
    got = {(r["doc_id"], r["node"]): (r["component"], r["size"]) for r in graph.strong_components(edges).collect()}
    assert got == {(1, 1): (1, 3), (1, 2): (1, 3), (1, 3): (1, 3), (1, 4): (4, 1), (1, 5): (5, 1), (2, 1): (1, 1), (2, 9): (9, 1)}


def test_components_match_mutual_reach():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(1, 9)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 16))]
        reach = {(a, a) for a in range(n)} | set(edges)
        for k in range(n):
            reach |= {(a, b) for a in range(n) for b in range(n) if (a, k) in reach and (k, b) in reach}
        want = {a: min(b for b in range(n) if (a, b) in reach and (b, a) in reach) for a in range(n)}
        assert graph._strong(list(range(n)), edges) == want


def test_reach_stops_at_barrier_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5)], "src long, dst long")
    roots, wall = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(4,)], "node long")
    assert {r["node"] for r in graph.reachable(edges, roots).collect()} == {1, 2, 3, 4, 5}
    assert {r["node"] for r in graph.reachable(edges, roots, wall).collect()} == {1, 2, 3}


@pytest.mark.parametrize(("name", "wall"), [("reach_all_links", 0), ("reach_all_links_with_barrier", 7)])
def test_reach_goes_over_every_link(spark, sf_dir, name, wall):
    from foliograph import registry

    read = lambda t, *columns: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*columns).collect()]
    customer, links = dict(read("orders", "o_orderkey", "o_custkey")), {}
    for order_key, part in read("lineitem", "l_orderkey", "l_partkey"):
        if order_key in customer:
            links.setdefault(customer[order_key], set()).add(-part)
            links.setdefault(-part, set()).add(customer[order_key])
    stops = lambda n: wall and n % wall == 0
    todo = [k for (k,) in read("customer", "c_custkey") if k <= 3 and not stops(k)]
    want = set(todo)
    while todo:
        new = {n for n in links.get(todo.pop(), ()) if n not in want and not stops(n)}
        want |= new
        todo += new
    got = [r["node"] for r in registry.QUERIES[name](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_deep_trees_keep_every_level(spark):
    rows = [(0, str(k), str(k - 1) if k else None, 0, "top" if not k else None) for k in range(68)]
    got = graph.flatten_tree(spark.createDataFrame(rows, "doc_id int, node string, parent string, ord int, box string").coalesce(1), ["box"])
    assert sorted((r["depth"], r["node"], r["box"]) for r in got.collect()) == [(k, str(k), "top") for k in range(68)]


def test_visible_counts():
    items = [{"id": 1, "parent": 0, "open": True}, {"id": 2, "parent": 1, "open": False}, {"id": 3, "parent": 2, "open": True}, {"id": 4, "parent": 1, "open": True}]
    assert dict(graph.visible_counts(items)) == {1: 2, 2: -1, 3: 0, 4: 0}


def test_freed_rows_let_older_ones_resurface(spark):
    rows = spark.createDataFrame([(1, 1, True, "a"), (1, 2, False, "b"), (2, 1, True, "c"), (2, 5, True, "d")], "k int, v int, live boolean, x string")
    got = latest.newest_wins(rows, ["k"], [F.col("v")], F.col("live"))
    assert {r["k"]: r["x"] for r in got.collect()} == {1: "a", 2: "d"}


def test_identity_never_merges(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7)], "doc int, num int").withColumn("digest", merkle.identity_digest(F.col("doc"), F.col("num")))
    assert rows.select("digest").distinct().count() == 2


def test_ties_round_to_even(spark):
    sizes = [1125, 12250, 100500, 1135, 999499, 999500, -1125, 0]
    assert told(spark, T.format_bytes, sizes, "long") == ["1,12 KB", "12,2 KB", "100 KB", "1,14 KB", "999 KB", "1,00 MB", "-1,12 KB", "0 B"]
    assert told(spark, T.format_duration, [4.125, 10.25, 59.95], "double") == ["4,12 s", "10,2 s", "60,0 s"]
    rnd = random.Random(41)
    values = [rnd.random() * 10 ** rnd.randint(-6, 9) for _ in range(300)] + [k / 16 for k in range(200)] + [2.675, 1.005, 0.5, 1.5, 2.5, 1e-300, 2.0**52 + 1]
    for places in (0, 1, 2):  # Python rounds a double's exact value, ties to even
        assert told(spark, lambda c, p=places: T.fixed(c, p, "en"), values, "double") == [f"{v:,.{places}f}" for v in values]
    assert told(spark, lambda c: T.fixed(c, 1, "en"), [None], "double") == [None]


def test_numbers_are_whole_texts(spark):
    yes = ["3", "-3.5e-7", "+.5", "5.", "1_000.2_5", "0x1p-2", "0X_1.8P3", "inf", "-Infinity", "NaN"]
    no = [" 3 ", "1d", "1f", "", ".", "1__0", "_1", "1_", "0x1", "1e999", "+nan", "e5", "1 2"]
    assert told(spark, T.is_number, [*yes, *no, None], "string") == [True] * len(yes) + [False] * len(no) + [None]


def test_distances_and_nearest_names(spark):
    rnd = random.Random(43)
    words = ["", "a", "Force", "froce", "ca", "abc", *("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 7))) for _ in range(60))]
    pairs = [(rnd.choice(words), rnd.choice(words)) for _ in range(300)]
    assert T.osa_distances(*map(list, zip(*pairs, strict=True))).tolist() == [T.osa_distance(a, b) for a, b in pairs]
    names = [(k, "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))) for k in range(400)]
    typed = [(w,) for w in {*words, None, "zzzzzz"}]
    got = T.closest_match(spark.createDataFrame(typed, "word string"), "word", spark.createDataFrame(names, "ord int, name string"))
    assert {r["word"]: r["closest"] for r in got.collect()} == {w: None if w is None else T.closest(w, [n for _, n in names]) for (w,) in typed}


def test_numbers_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("concat('k', lpad(id * 7919 % 3000, 5, '0')) AS key").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS key"))
    got = order.renumbered(rows, "key", parts=2000)
    assert [tuple(r) for r in got.orderBy("new_no").collect()] == [(None, 1), *((f"k{n:05}", n + 2) for n in range(3000))]
    assert order.renumbered(rows.limit(0), "key").count() == 0


def test_cycles_below_a_root_and_very_deep_trees(spark):
    nodes = [(0, "a", None, 0), (0, "b", "a", 0), (0, "x", "y", 0), (0, "y", "x", 0)]
    got = graph.flatten_tree(spark.createDataFrame(nodes, "doc_id int, node string, parent string, ord int"), [])
    assert sorted(r["node"] for r in got.collect()) == ["a", "b"]  # no root reaches the others


def test_visible_descendants_match_the_list(spark):
    rnd = random.Random(47)
    items = [{"id": k, "parent": rnd.randrange(k) if k > 1 else 0, "open": rnd.random() < 0.6} for k in range(1, 60)]
    rows = [(0, str(x["id"]), str(x["parent"]) if x["parent"] else None, x["id"], x["open"]) for x in items]
    got = graph.visible_descendants(spark.createDataFrame(rows, "doc_id int, node string, parent string, ord int, is_open boolean"), "is_open")
    assert {int(r["node"]): r["visible"] for r in got.collect()} == {k: n for k, n in graph.visible_counts(items)}


def test_null_names_and_mixed_families(spark):
    rnd = random.Random(53)
    names = ["a", "a_2", "a_3", "b", "b_2_2", "c", None]
    rows = [(k, rnd.choice(names[:3] if k % 2 else names), rnd.choice([1, 2, 3, None])) for k in range(120)]
    got = rename.rename_conflicts(spark.createDataFrame(rows, "k int, name string, owner int"), "name", "owner", "k")
    want = rename.free_names([(n, o) for _, n, o in rows])
    assert [r["new_name"] for r in got.orderBy("k").collect()] == want
    assert rename.free_names([(None, 1), (None, 2)]) == [None, None]


def test_parents_of_many_children(spark):
    kids = spark.range(9000).selectExpr("id % 2 AS p", "sha2(CAST(id AS STRING), 256) AS digest").where("p = 0 OR digest < '08'")
    parents = spark.createDataFrame([(0,), (1,), (2,)], "p long")
    got = {r["p"]: r["digest"] for r in merkle.with_children(parents, kids, "p", F.lit("x")).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [sorted(r["digest"] for r in kids.where(f"p = {k}").collect()) for k in (0, 1)]
    chunks = [digest("".join(own[0][k : k + merkle.CHUNK])) for k in range(0, len(own[0]), merkle.CHUNK)]
    assert got == {0: digest("x|" + "".join(chunks)), 1: digest("x|" + "".join(own[1])), 2: digest("x|")}


def test_many_claims_of_one_name_are_dealt_in_time():
    rnd = random.Random(59)
    claims = [(rnd.choice(["a", "a_2", "a_5", "a_2_3"]), rnd.choice([1, 2, 3, None])) for _ in range(800)]
    taken, want = {}, []
    for name, owner in claims:  # every number is tried anew
        numbered = (f"{name}_{k}" for k in range(2, 1000))
        own = name if taken.get(name, owner) == owner else next(x for x in numbered if x not in taken)
        taken.setdefault(own, owner)
        want.append(own)
    assert rename.free_names(claims) == want

    class Name(str):
        made = 0

        def __format__(self, spec):
            Name.made += 1
            return str(self)

    names = [Name("a"), Name("a_2")]
    got = rename.free_names([(names[k % 5 == 0], k % 25) for k in range(5000)])
    assert len(set(got)) > 4000 and Name.made < 15000  # each number once, not all of them for each claim


def test_sizes_beyond_the_last_unit(spark, tmp_path):
    import duckdb

    from foliograph import registry

    sizes = [999, 999_600_000_000, 1_322_500_000_000, 2_270_123_456_789_012, 999_499_999_999, 37]
    assert told(spark, T.format_bytes, sizes, "long") == ["999 B", "1,00 TB", "1,32 TB", "2,27 PB", "999 GB", "37 B"]
    assert told(spark, lambda c: T.format_bytes(c, "en", "GB"), sizes, "long")[1:4] == ["1,000 GB", "1,322 GB", "2,270,123 GB"]
    rows = [(n % 7, n // (37 * (n % 7 + 1))) for n in sizes] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE["format_bytes"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["format_bytes"](spark, str(tmp_path)).collect()) == want
    assert {"1000 GB", "1322 GB", "2270123 GB"} <= {size for _, size in want}


@pytest.mark.parametrize("batch", [7, 10000])
def test_one_hash_over_all_children(spark, batch):
    rnd = random.Random(61)
    kids = [(k, hashlib.sha256(str(rnd.randrange(3000)).encode()).hexdigest()) for k, n in ((1, 9000), (2, 30), (4, 1), (9, 5)) for _ in range(n)]
    rnd.shuffle(kids)
    rows = spark.createDataFrame([*kids, (None, "aa"), (2, None)], "p long, digest string")
    parents = [(1, "x", 5), (2, "ñ", 6), (2, "y", 7), (3, "z", 8), (None, "n", 9), (4, None, 10)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = merkle.with_all_children(spark.createDataFrame(parents, "p long, own string, c int"), rows, "p", F.col("own")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    told = lambda p, own: own and hashlib.sha256(f"{own}|{''.join(sorted(d for k, d in kids if k == p))}".encode()).hexdigest()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [(p, own, c, told(p, own)) for p, own, c in parents]


def test_hierarchy_of_many_customers_matches_its_sql(spark, sf_dir, tmp_path):
    import duckdb
    from compare import TABLES

    from foliograph import registry

    con = duckdb.connect()
    for t in TABLES[:7]:
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "customer":  # more of a nation than are hashed at once
            more = spark.range(merkle.CHUNK + 500).selectExpr("id + 1000000 AS c_custkey", "concat('more', id) AS c_name", "3 AS c_nationkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment")
            rows = rows.unionByName(more)
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE["merkle_hierarchy"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["merkle_hierarchy"](spark, str(tmp_path)).collect()) == want
