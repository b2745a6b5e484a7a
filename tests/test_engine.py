"""The document engine on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.re2 import accepted
from tidemark.functions.variant import fnv1a
from tidemark.operators import admission, filters, index, lww, migrate, partition, placement, query, replicas
from tidemark.sources import log as source
from tidemark.sources import records
from tidemark.streaming import feed

DOC = {"age": 30, "name": "alice", "tags": ["a"], "score": 9.5}
MATRIX = [
    ({}, True), ({"age": 30}, True), ({"age": 30.0}, True), ({"age": "30"}, False), ({"age": {"$gt": 29}}, True), ({"age": {"$gt": 30}}, False), ({"age": {"$gte": 30, "$lte": 30}}, True),
    ({"age": {"$lt": "40"}}, False), ({"name": {"$lt": "bob"}}, True), ({"name": {"$ne": "bob"}}, True), ({"none": {"$ne": "bob"}}, True), ({"none": {"$ne": None}}, False), ({"name": {"$in": ["bob", "alice"]}}, True),
    ({"name": {"$in": []}}, False), ({"name": {"$in": "alice"}}, False), ({"none": {"$in": [None]}}, True), ({"name": {"$exists": True}}, True), ({"none": {"$exists": False}}, True), ({"name": {"$exists": "yes"}}, False),
    ({"name": {"$regex": "^al"}}, True), ({"name": {"$regex": "["}}, False), ({"name": {"$regex": "(?=a)"}}, False), ({"age": {"$regex": "3"}}, False), ({"tags": ["a"]}, True), ({"tags": ["b"]}, False), ({"tags": {"$gt": 1}}, False),
    ({"age": {"$eq": 30}}, False), ({"age": {}}, True), ({"none": None}, True), ({"age": None}, False), ({"score": {"$gt": 9, "$lt": 10}, "age": 30}, True),
]


def test_predicates_on_both_layouts(spark):
    variant = spark.range(1).select(F.parse_json(F.lit(json.dumps(DOC))).alias("fields"))
    columnar = spark.createDataFrame([tuple(DOC.values())], "age int, name string, tags array<string>, score double")
    for df in (variant, columnar):
        got = df.select(*(F.coalesce(filters.compile_filter(f, query.backend_of(df)), F.lit(False)).alias(str(i)) for i, (f, _) in enumerate(MATRIX))).first()
        assert [(f, g) for (f, _), g in zip(MATRIX, got)] == MATRIX


def test_explicit_null_is_present_only_in_variants(spark):
    df = spark.createDataFrame([(1, '{"k":null}'), (2, "{}"), (3, '{"k":1}')], "n int, j string").select("n", F.parse_json("j").alias("fields"))
    ids = lambda f: [r.n for r in df.where(filters.compile_filter(f, query.backend_of(df))).orderBy("n").collect()]
    assert ids({"k": {"$exists": True}}) == [1, 3] and ids({"k": None}) == [1, 2] and ids({"k": {"$ne": 1}}) == [1, 2]


def test_bad_filters_and_pages(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(5)], "id string, score int")
    for bad in ("[1]", "{", "3"):
        with pytest.raises(ValueError):
            query.find(df, bad)
    with pytest.raises(ValueError):
        query.find(df, limit=-1)
    assert [r.score for r in query.find(df, sort="score", limit=2, offset=2).collect()] == [2, 3]
    assert query.find(df, limit=0).count() == 0 and query.find(df, offset=9).count() == 0


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = query.find(df, {"o_totalprice": {"$gte": 5}, "o_orderpriority": {"$in": ["2-HIGH", "5-LOW"]}}, sort="o_totalprice", limit=3, id="o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in plan and "In(o_orderpriority" in plan and "TakeOrderedAndProject" in plan


LOG = [("c", "a", 1, 10, False, 0), ("c", "a", 2, 20, False, 1), ("c", "b", 1, 15, False, 2), ("c", "b", 2, 30, True, 3), ("c", "a", 2, 20, True, 4), ("d", "x", 1, 5, True, 5)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, "collection string, id string, ver long, ts long, deleted boolean, n long")


def test_last_writer_wins(spark, log):
    state = lambda df: sorted((r.id, r.ver, r.deleted) for r in df.collect())
    want = [("a", 2, False), ("b", 2, True), ("x", 1, True)]
    assert state(lww.lww(log, "n")) == want and state(lww.lww(log.unionAll(log).repartition(5), "n")) == want
    assert state(lww.point_in_time(log, 15, "n")) == [("a", 1, False), ("b", 1, False), ("x", 1, True)]
    assert lww.applied_count(log, 100, "n").first().applied == 5
    assert state(lww.compact(log, 40, 10, "n")) == [("a", 2, False)]
    assert {r.collection for r in query.collections(log).collect()} == {"c", "d"}
    new = lww.upsert(log, spark.createDataFrame([("c", "b"), ("c", "z")], "collection string, id string"), 50)
    assert sorted((r.id, r.ver) for r in new.collect()) == [("b", 3), ("z", 1)]
    assert lww.parse_until("1970-01-01T00:00:01Z") == 1000 and lww.needed("quorum", 5) == 3
    with pytest.raises(ValueError):
        lww.needed("most", 3)


@pytest.mark.parametrize("key", [None, "00" * 32])
@pytest.mark.parametrize("batch", [False, True])
def test_log_round_trip(spark, tmp_path, key, batch):
    docs = spark.createDataFrame([("c", "a", 1, 5, False, '{"x":"1"}'), ("c", "b", 2, 6, True, None)], "collection string, id string, ver long, ts long, deleted boolean, j string")
    docs = docs.withColumn("fields", F.try_parse_json("j")).drop("j").coalesce(1)
    path = str(tmp_path / "log")
    source.write_log(docs, path, key, batch=batch)
    (tmp_path / "log" / "part-torn.txt").write_text('{"id":"torn\n\n')
    got = sorted((r.id, r.ver, r.ts, r.deleted, r.j) for r in source.read_log(spark, path, key).withColumn("j", F.to_json("fields")).collect())
    assert got == [("a", 1, 5, False, '{"x":"1"}'), ("b", 2, 6, True, None)]
    if key:
        with pytest.raises(Exception):
            source.read_log(spark, path, "11" * 32).collect()
    else:
        with pytest.raises(Exception):
            source.read_log(spark, path, strict=True).collect()


def test_log_order_breaks_ties(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(json.dumps({"id": "k", "ver": 1, "ts": 1, "collection": "c", "fields": {"n": i}}) + "\n" for i in range(50)))
    got = lww.lww(source.read_log(spark, str(tmp_path)), "at").select(F.to_json("fields")).first()[0]
    assert got == '{"n":0}'


def test_backup_and_restore(spark, tmp_path, log):
    docs = lww.lww(log, "n").drop("n").withColumn("fields", F.parse_json(F.lit("{}")))
    source.backup(docs, str(tmp_path / "b"))
    restored = lww.lww(source.restore(docs.limit(0), spark, str(tmp_path / "b")))
    assert sorted((r.id, r.ver, r.deleted) for r in restored.collect()) == [("a", 2, False), ("b", 2, True), ("x", 1, True)]


def test_feed_file_and_hints(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    lines = [json.dumps({"seq": i, "ts": i, "collection": "c", "id": "x", "kind": "upsert"}) for i in range(1, 6)]
    (tmp_path / "feed" / "f.jsonl").write_text("\n".join(lines) + '\n{"seq": 6')
    got = source.read_feed(spark, str(tmp_path / "feed"))
    assert got.count() == 5 and feed.head(got).first().head == 5 and feed.retained(got, 5, 3, 100).count() == 3
    (tmp_path / "feed" / "f.jsonl").write_text(lines[0] + "\nbroken\n" + lines[1])
    with pytest.raises(Exception):
        source.read_feed(spark, str(tmp_path / "feed")).collect()
    (tmp_path / "hints").write_text('{"target":"n1","doc":{"collection":"c","id":"a","ver":1,"ts":2},"attempts":3,"next_retry":9}\nbad\n{"target":"","doc":{}}\n')
    assert [(r.target, r.id, r.attempts) for r in source.read_hints(spark, str(tmp_path / "hints")).collect()] == [("n1", "a", 3)]
    with pytest.raises(ValueError):
        source.load_tenants('[{"name":"a","token":"t"},{"name":"b","token":"t"}]')


def test_streamed_index_follows_the_feed(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("feed", "index", "check"))
    event = lambda seq, id, kind, value=None: (seq, seq, "c", id, kind, value)
    for rows in ([event(1, "a", "upsert", "x"), event(2, "b", "upsert", "y"), event(3, "c", "upsert", "x")], [event(4, "a", "upsert", "y"), event(5, "c", "delete"), event(6, "d", "upsert")]):
        spark.createDataFrame(rows, feed.EVENT).coalesce(1).write.mode("append").json(path)
        feed.maintain_index(spark, path, out, check, "by").awaitTermination()
    state = feed.index_state(spark, out)
    assert sorted((r.id, r.value) for r in state.collect()) == [("a", "y"), ("b", "y")]
    assert index.secondary_lookup(state, "c", "by", "y").count() == 2


def test_watch_streams_events_after_a_cursor(spark, tmp_path):
    spark.createDataFrame([(i, i, "c" if i % 2 else "d", "x", "upsert", None) for i in range(6)], feed.EVENT).write.json(str(tmp_path / "feed"))
    job = feed.watch(spark, str(tmp_path / "feed"), "c", 1).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(json.loads(r.event)["seq"] for r in spark.table("watched").collect()) == [3, 5]


def test_numbering_is_gapless(spark):
    got = feed.numbered(spark.range(200).repartition(7), 40, [F.col("id")]).orderBy("id").collect()
    assert [r.seq for r in got] == list(range(41, 241))


def test_retype_table(spark):
    cases = [("float", "3.5", 3.5), ("float", True, 1.0), ("int", "42.0", 42), ("int", 7.9, 7), ("int", -7.9, -7), ("string", 9.0, "9"), ("string", 9.5, "9.5"), ("string", False, "false"), ("bool", "true", True), ("bool", 0, False), ("int", "abc", None)]
    for target, value, want in cases:
        df = spark.createDataFrame([(value,)], ["v"])
        assert migrate.apply(df, [migrate.Transform("retype", "v", target)]).first().v == want, (target, value)
    for bad in ([migrate.Transform("retype", "a", "date")], [migrate.Transform("rename", "a")], [migrate.Transform("drop", "_schema_ver")], [migrate.Transform("copy", "a", "b")]):
        with pytest.raises(ValueError):
            migrate.validate(bad)
    one = migrate.Transform("drop", "a")
    with pytest.raises(ValueError):
        migrate.validate([one], 1, [one, one])


VALUES = [
    ("float", "3.5", 3.5), ("float", True, 1), ("float", "x", "x"), ("int", "42", 42), ("int", 7.9, 7), ("int", -7.9, -7), ("int", True, True), ("int", "abc", "abc"), ("string", 9, "9"), ("string", False, "false"),
    ("string", 1234567.5, "1.2345675e+06"), ("string", 0.00025, "0.00025"), ("string", -1.5e-7, "-1.5e-07"), ("string", 123.25, "123.25"), ("bool", "true", True), ("bool", "yes", "yes"), ("bool", 0, False), ("bool", None, None), ("int", [1], [1]),
]


def test_retype_of_variants_keeps_what_it_cannot_convert(spark):
    rows = spark.createDataFrame([(i, json.dumps({"v": v})) for i, (_, v, _) in enumerate(VALUES)], "n int, j string").select("n", F.parse_json("j").alias("fields"))
    for target in migrate.TARGETS:
        got = {r.n: json.loads(r.j) for r in migrate.read(rows, [migrate.Transform("retype", "v", target)]).select("n", F.to_json("fields").alias("j")).collect()}
        for i, (t, v, want) in enumerate(VALUES):
            if t == target:
                assert got[i] == {"v": want, "_schema_ver": 1} and type(got[i]["v"]) is type(want), (t, v)


def test_variant_documents_are_migrated_from_their_version(spark):
    rows = [("u1", '{"city":"Lisbon","age":"42"}'), ("u2", '{"town":"Porto","age":30,"_schema_ver":2}'), ("u3", "[1]"), ("u4", None), ("u5", '{"city":"x","town":"y"}'), ("u6", '{"city":"z","_schema_ver":1}')]
    df = spark.createDataFrame(rows, "id string, j string").select("id", F.parse_json("j").alias("fields"))
    rules = [migrate.Transform("rename", "city", "town"), migrate.Transform("retype", "age", "int")]
    got = {r.id: r.j and json.loads(r.j) for r in migrate.read(df, rules).select("id", F.to_json("fields").alias("j")).collect()}
    assert got == {"u1": {"town": "Lisbon", "age": 42, "_schema_ver": 2}, "u2": {"town": "Porto", "age": 30, "_schema_ver": 2}, "u3": [1], "u4": None, "u5": {"town": "x", "_schema_ver": 2}, "u6": {"city": "z", "_schema_ver": 2}}
    assert [r.id for r in query.find(df, {"age": {"$gte": 30}}, sort="age", schema=rules).collect()] == ["u2", "u1"]
    again = migrate.read(migrate.read(df, rules), rules)
    assert {r.id: r.j and json.loads(r.j) for r in again.select("id", F.to_json("fields").alias("j")).collect()} == got
    with pytest.raises(ValueError):
        migrate.apply(df, rules)


@pytest.mark.parametrize("pattern", ["[", "(", "a**", "a{2}{3}", "*a", "(?=a)", "(?<!a)", r"\1", r"\k<a>", "(?P<a>x)(?P<a>y)", "x{1001}", "a{3,2}", r"\Z", r"\p{Nope}", "[[:nope:]]", "[z-a]", "(?x)a", "a)", r"\x{110000}", 5, "(?#c)"])
def test_patterns_that_are_refused(spark, pattern):
    assert accepted(spark, pattern) is None


@pytest.mark.parametrize("pattern", [r"(?P<n_1>a)b", r"\p{Lu}", r"\pN+", "a(?i)B", "(?i:a)B", "[[:alpha:]]+[^[:digit:]]", "[]a]x", "a{,2}", "a$", "(?m)^b$", r"\bfoo\b", r"\Bo", "[a&&b]", r"[\w.-]+@", r"a\Q.*\E", "(?s)a.b", "a.b", "a|", "(?U)a+?", r"\s\d", r"\x{e9}", r"\p{Greek}", "[^\\s]", "#[a-f]", "[-a]b", "[a-]b", r"\07"])
def test_patterns_match_as_in_the_linear_engine(spark, pattern):
    import duckdb

    texts = ["ab", "aB", "AB", "a\nb", "b\n", "a\n", "a", "", "foo bar", "food", "é 1", "α", "]x", "a{,2}", "&b", "x@y", "a.*", "٣", "#c", "-b", "a-b", "\x07", "a\r", "\x0b1", " 7", "Éa"]
    java = accepted(spark, pattern)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").orderBy("n").select(F.col("t").rlike(java)).collect()]
    assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts]


def test_partition_ids(spark):
    df = spark.createDataFrame([("alice|001|x", "alice"), ("bob", "bob"), ("bob|2", "eve"), ("z|1", None)], "id string, user string")
    assert [r[0] for r in df.select(partition.sort_part(F.col("id"))).collect()] == ["001|x", "", "2", ""[:0] or "1"]
    assert [r.problem is None for r in partition.check_ids(df, "user").collect()] == [True, False, False, False]
    assert not partition.single_partition(df).first().single
    with pytest.raises(ValueError):
        partition.range_query(df, "bob", partition=F.col("user"), sort=F.col("id"), config={"rf": 3})
    assert partition.range_query(df, "bob", partition=F.col("user"), sort=F.col("id"), config={"partition_field": "user"}).count() == 1


def test_inverted_index_of_variants(spark):
    df = source.columnar(spark.createDataFrame([("u1", "Lisbon", 30), ("u2", "Berlin", 30), ("u3", "Lisbon", None)], "k string, city string, age int"), "users", F.col("k"))
    entries = index.variant_entries(df)
    assert [r.id for r in index.lookup(entries, "city", '"Lisbon"').collect()] == ["u1", "u3"] and [r.id for r in index.lookup_range(entries, "age", 20, 40).collect()] == ["u1", "u2"]
    with pytest.raises(ValueError):
        index.checked_definition("_x", "f")


def test_replica_comparison(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a = spark.createDataFrame([(c, h(c)) for c in "abcdefgh"], "id string, hash string")
    b = spark.createDataFrame([(c, h(c + "2") if c in "beg" else h(c)) for c in "abcdefgh"], "id string, hash string")
    assert sorted(r.id for r in replicas.diff(a, b).collect()) == sorted(r.id for r in replicas.diff_buckets(a, b).collect()) == ["b", "e", "g"]
    level = [h(c) for c in "abcdefgh"]
    while len(level) > 1:
        level = [h(x + y) for x, y in zip(level[::2], level[1::2])]
    assert replicas.root(a).first().root == level[0]
    five = [h(c) for c in "abcde"] + [h("")] * 3
    while len(five) > 1:
        five = [h(x + y) for x, y in zip(five[::2], five[1::2])]
    assert replicas.root(a.where("id < 'f'")).first().root == five[0]


def test_ring_and_plans(spark):
    assert placement.token("a") == 3826002220 and placement.token("foobar") == 3214735720
    assert [r[0] for r in spark.createDataFrame([("a",), ("foobar",), ("",)], "s string").select(fnv1a(F.col("s"))).collect()] == [3826002220, 3214735720, 2166136261]
    nodes = ["n1", "n2", "n3"]
    ring = placement.Ring.build(nodes)
    keys = spark.range(300).select(F.concat(F.lit("c/"), F.col("id").cast("string")).alias("k"))
    placed = placement.place(keys, ring, F.col("k"), 2).collect()
    assert len(placed) == 300 and all(r.owners == ring.owners(r.k, 2) for r in placed)
    load = [1.0] * 256
    load[200] = 100.0
    ranges = placement.plan(nodes, 2, load, ring)
    assert ranges[0].start == 0 and ranges[-1].end == 0 and all(x.end == y.start for x, y in zip(ranges, ranges[1:])) and all(len(set(r.owners)) == 2 for r in ranges)
    again = placement.plan(nodes, 2, [x * 1.03 for x in load], ring, ranges)
    assert placement.movements(ranges, again) == 0 and placement.plan(nodes, 2, [0.0] * 256, ring) is None
    assert placement.movements(None, ranges) == len(ranges) and placement.plan(["n1"], 2, load, ring) is None and placement.plan(nodes, 0, load, ring) is None
    low, high = placement.split_range(ranges[0], ranges[0].start + 1)
    assert placement.merge_ranges(low, high) == ranges[0]


def test_plan_sheds_what_is_above_the_band():
    nodes, ring = ["a", "b", "c"], placement.Ring.build(["a", "b", "c"])
    load = [0.5] * 256
    load[10], load[200] = 200.0, 150.0
    fresh = placement.plan(nodes, 2, load, ring)
    assert placement.movements(fresh, placement.plan(nodes, 2, load, ring, fresh)) == 0
    assert len({r.owners[0] for r in fresh if r.load > 50}) >= 2
    # a node leaves: only its ranges move
    after = placement.plan(["a", "b"], 2, load, placement.Ring.build(["a", "b"]), fresh)
    old = {r.start: r.owners[0] for r in fresh}
    assert all(old[r.start] == r.owners[0] for r in after if old.get(r.start) in ("a", "b") and r.load > 50)
    # all on one node before: the largest ranges leave it until it is inside the band
    even = [1.0] * 256
    one = [placement.Range(0, 0, ["a"], 256.0)]
    held = {}
    for r in placement.plan(nodes, 1, even, ring, one):
        held[r.owners[0]] = held.get(r.owners[0], 0) + r.load
    fair = sum(even) / 3
    assert set(held) == set(nodes) and max(held.values()) <= placement.BAND * fair + max(r.load for r in placement.plan(nodes, 1, even, ring, one))
    # replicas follow the ring's owners of the range's start
    for r in fresh:
        assert r.owners[1] == next(n for n in ring.owners(f"rng/{r.start}", 6) if n != r.owners[0])


def test_planned_rows_match_single_keys(spark):
    nodes, ring = ["a", "b", "c"], placement.Ring.build(["a", "b", "c"])
    load = [1.0] * 256
    load[7] = 90.0
    ranges = placement.plan(nodes, 2, load, ring)[1:]  # a gap at the start
    keys = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for epoch in (1, 2):
        for r in placement.place_planned(keys, ranges, 1, epoch, ring, F.col("k"), 2).collect():
            assert r.owners == placement.placement(ranges, 1, epoch, ring, r.k, 2)


def test_remote_records_are_read_page_by_page(spark):
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, HTTPServer

    held = [{"collection": "c", "id": f"d{i:02d}", "ver": 1 + i % 2, "ts": i, "deleted": i == 4, "fields": None if i == 4 else {"i": i}} for i in range(11)]

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urllib.parse.urlparse(self.path)
            asked = dict(urllib.parse.parse_qsl(at.query, keep_blank_values=True))
            page = [r for r in held if r["id"] > asked["after"]][: int(asked["limit"])] if at.path == "/internal/record/c/scan" else []
            body = json.dumps({"records": page, "epoch": 7}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(records.RecordSource)
    url = f"http://127.0.0.1:{server.server_port}"
    rows = spark.read.format("records").option("urls", f"{url}, {url}").option("collection", "c").option("page", "4").load()
    got = rows.collect()
    assert len(got) == 22 and {(r.id, r.ver, r.deleted, r.epoch) for r in got} == {(r["id"], r["ver"], r["deleted"], 7) for r in held}
    assert query.find(rows.dropDuplicates(["id"]).withColumn("fields", F.parse_json("fields")), {"i": {"$gt": 8}}).count() == 2
    assert spark.read.format("records").option("url", url).option("collection", "none").load().count() == 0
    server.shutdown()


def test_reopened_feed_keeps_its_head(spark):
    rows = spark.createDataFrame([(i, i, "c", "x", "upsert", None) for i in range(1, 11)], feed.EVENT)
    got = feed.reopened(rows, 10, 3, 100).collect()
    assert sorted(r.seq for r in got) == [8, 9, 10] and {r.head for r in got} == {10}
    assert source.archive_name("/a/log/", 1_600_000_000_123) == "/a/log-20200913T122640123"


def test_hints_come_due_and_wait_longer(spark):
    hints = spark.createDataFrame([("n1", 1, 5), ("n1", 9, 50), ("n2", 0, 7)], "target string, attempts int, next_retry long")
    due = admission.due_hints(hints, 7)
    assert sorted(r.next_retry for r in due.collect()) == [5, 7]
    assert sorted((r.attempts, r.next_retry) for r in admission.reschedule(due, 100).collect()) == [(1, 100 + 2000), (2, 100 + 4000)]
    assert {r.target: r.pending for r in admission.hint_stats(hints).collect()} == {"n1": 2, "n2": 1}


def test_rate_limit_and_idempotency(spark):
    rows = spark.createDataFrame([(i, "t", i * 100) for i in range(10)] + [(50, "u", 0), (51, "u", 10_000)], "n long, k string, at long")
    allowed = {r.n: r.allowed for r in admission.rate_limit(rows, "k", "at", "n", rps=1, burst=3).collect()}
    assert [allowed[i] for i in range(10)] == [True] * 3 + [False] * 7 and allowed[50] and allowed[51]
    ran = {r.n: r.executed for r in admission.idempotent(rows, "k", "at", "n", 250).collect()}
    assert [ran[i] for i in range(10)] == [True, False, False, True, False, False, True, False, False, True]
    waits = spark.createDataFrame([(1,), (5,), (40,)], "a int").select(admission.backoff(F.col("a"))).collect()
    assert [r[0] for r in waits] == [2000, 32000, 300000]
