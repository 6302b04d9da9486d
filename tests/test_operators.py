"""Hand-sized cases: ties, nulls, empty input, cycles, odd values, and what must hold of several operators together."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagetrail import schemas
from pagetrail.functions import scalars as S
from pagetrail.operators import accounts, changes, files, pages, search, tree
from pagetrail.sources import tables

LOG = "seq long, url string, op string, user_id long"


def users(spark, rows):
    return spark.createDataFrame([(i, p, u, 0, "", "", n) for i, p, u, n in rows], schemas.USERS)


@pytest.fixture(scope="module")
def family(spark):
    """An admin, one invited user and eight users below."""
    return users(spark, [(1, 0, "admin", None), (2, 1, "guest", 1), *((k + 3, 2, c, 0) for k, c in enumerate("abcdefgh"))])


def chained(data, chunk):
    h = b""
    for i in range(0, len(data), chunk):
        h = hashlib.sha256(h + hashlib.sha256(data[i : i + chunk]).digest()).digest()
    return h.hex()


def test_chained_hash(spark):
    contents = [b"", b"a", b"x" * 8, b"x" * 9, bytes(range(256)) * 3]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    got = {r.id: r.h for r in df.select("id", S.chained_hash(F.col("content"), 8).alias("h")).collect()}
    assert got == {i: chained(c, 8) for i, c in enumerate(contents)}


def test_page_id_is_unsigned(spark):
    urls = [f"https://a/{i}" for i in range(50)] + ["", "a'b\"c"]
    got = {r.url: int(r.id) for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", S.page_id(F.col("url")).alias("id")).collect()}
    assert got == {u: int(hashlib.sha256(u.encode()).hexdigest()[:16], 16) for u in urls}
    assert max(got.values()) > 1 << 63


def test_session_parts_and_ages(spark):
    df = spark.createDataFrame([("a@h",), ("a@h@x",), ("a",), (None,)], "k string").select(S.session_parts(F.col("k")).alias("s"))
    assert [r.s and tuple(r.s) for r in df.collect()] == [("a", "h"), ("a", "h@x"), None, None]
    day, now = 86400, 100 * 86400
    ages = spark.createDataFrame([(now - d * day,) for d in (0, 1, 6, 7, 29, 30)], "ts long").select(S.age_label(F.col("ts"), F.lit(now)).alias("a"))
    assert [r.a for r in ages.collect()] == ["Today", "Yesterday", "6 days ago", "1 weeks ago", "4 weeks ago", "Mar 12, 1970"]


def test_annotations(spark):
    rows = [(1, '{"title": "t", "direct_keywords": ["a", "b"]}'), (2, '{"title": null}'), (3, '{"title"'), (4, None), (5, "")]
    good, bad = tables.parse_annotations(spark.createDataFrame(rows, "id int, text string"), "text")
    assert [(r.id, r.annotation.title, r.annotation.direct_keywords) for r in good.orderBy("id").collect()] == [(1, "t", ["a", "b"]), (2, None, None)]
    assert sorted(r.id for r in bad.collect()) == [3, 4, 5]


def test_extract_text(spark):
    html = '<html><head><title>A &amp; B</title><style>x</style></head><body><header>Top</header><script>var t="</p>";</script><!-- c --><h1>H</h1><p>One &lt;two&gt;. Three</p></body>'
    got = pages.extract_text(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert (got[0].title, got[0].h1, got[0].body) == ("A & B", "H", "Top H One <two>. Three")
    assert all((r.title, r.h1, r.body) == ("", "", "") for r in got[1:])


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "index", 1), (2, "b'\"", "index", 1)], LOG)
    new = spark.createDataFrame([(3, "a", "index", 2), (4, "a", "index", 3), (5, "c", "index", 3)], LOG)
    once = changes.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, changes.upsert(once, new).collect())) == [(2, "b'\"", "index", 1), (4, "a", "index", 3), (5, "c", "index", 3)]
    assert changes.upsert(old.limit(0), new.limit(0)).count() == 0


def test_log_and_deletes(spark):
    log = spark.createDataFrame([(1, "a", "index", 1), (2, "a", "delete", 1), (3, "b", "index", 2), (4, "a", "index", 1), (5, "b", "delete", 2)], LOG)
    assert [r.seq for r in changes.apply_log(log).collect()] == [4]
    assert [r.seq for r in changes.recent_captures(log, 2).collect()] == [4, 3]
    gone = spark.createDataFrame([("a",)], "url string")
    assert changes.delete_by_url(log, gone).count() == 2
    assert changes.delete_by_url(log, gone, user_id=2).count() == 5


def test_tree(spark, family):
    assert {r.id: r.children for r in tree.child_counts(family).collect()} == {1: 1, 2: 8, **{k: 0 for k in range(3, 11)}}
    assert tuple(tree.tree_stats(family).first()) == (10, 0.9, 3)
    assert tuple(tree.tree_stats(family.limit(0)).first()) == (0, 0.0, 0)
    lost = users(spark, [(5, 99, "x", 0), (6, None, "y", 0), (7, 5, "z", 0)])
    assert {r.id: r.depth for r in tree.depths(lost).collect()} == {5: 0, 6: 0, 7: 1}


def test_cycle_ends(spark):
    loop = users(spark, [(1, 3, "a", 0), (2, 1, "b", 0), (3, 2, "c", 0)])
    assert {r.id: r.depth for r in tree.descendants(loop, spark.createDataFrame([(1,)], "id long")).collect()} == {1: 0, 2: 1, 3: 2}
    assert tree.depths(loop).count() == 0


def test_deep_tree(spark):
    chain = [(i, i - 1, "", 0) for i in range(1, 42)] + [(7, 3, "", 0), (50, 51, "", 0), (51, 50, "", 0), (52, 51, "", 0)]
    deep = users(spark, chain)
    # user 7 also has parent 3: what is below counts from there
    assert {r.id: r.depth for r in tree.depths(deep).collect()} == {i: i - 1 if i < 7 else i - 4 for i in range(1, 42)}
    two = spark.createDataFrame([(2,), (30,), (30,)], "id long")
    assert {r.id: r.depth for r in tree.descendants(deep, two).collect()} == {i: i - 30 if i > 29 else i - 2 if i < 7 else i - 5 for i in range(2, 42)}


def test_delete_users(spark, family):
    live = spark.createDataFrame([("k", "h", 2, 0, 9), ("m", "h", 1, 0, 9), ("n", "h", 5, 0, 9)], schemas.SESSIONS)
    two = spark.createDataFrame([(2,), (77,)], "id long")
    left, sessions, n = tree.delete_users(family, live, two, recursive=False)
    assert n.first().n == 1 and left.count() == 9 and {r.parent_id for r in left.collect()} == {0, None} and sessions.count() == 2
    left, sessions, n = tree.delete_users(family, live, two, recursive=True)
    assert n.first().n == 9 and [r.id for r in left.collect()] == [1] and [r.user_id for r in sessions.collect()] == [1]


def test_accounts(spark, family):
    who = spark.createDataFrame([("2",), ("guest",), ("nobody",)], "ident string")
    assert sorted(r.ident for r in accounts.resolve_users(who, family).collect()) == ["2", "guest"]
    raised = accounts.bump_counters(family, spark.createDataFrame([(1,), (1,), (2,)], "id long"))
    assert {r.id: r.invite_counter for r in raised.collect() if r.id < 4} == {1: 2, 2: 2, 3: 0}
    assert accounts.redact(family).columns == ["username", "creation_datetime"]
    resolved = spark.createDataFrame([(1, "h0", None), (2, "h1", "admin"), (3, "h0", "guest"), (4, "h0", "admin")], "request_id long, host string, username string")
    assert [r.access for r in accounts.classify_access(resolved, "h0", False, True).orderBy("request_id").collect()] == ["missing_user", "foreign", "not_admin", "ok"]


def test_files(spark):
    f = spark.createDataFrame([(2, "h", "b", 0, 1, 0), (1, "h", "a", 0, 1, 1), (3, "g", "c", 0, 1, 0)], schemas.FILES)
    assert {r.id: (r.stored_id, r.is_first) for r in files.file_dedup(f).collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    asked = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 2, True), (4, 9, True)], "request_id long, file_id long, valid boolean")
    assert [r.decision for r in files.file_access(asked, f).orderBy("request_id").collect()] == ["ok", "private", "ok", "no_metadata"]


def test_store_and_read_contents(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, bytearray(b""))], "id long, content binary")
    known = spark.createDataFrame([(hashlib.sha256(b"").hexdigest(),)], "hash string")
    assert [bytes(r.content) for r in tables.store_contents(df, known).collect()] == [b"x"]
    (tmp_path / "f").write_bytes(b"abc")
    assert [bytes(r.content) for r in tables.read_contents(spark, str(tmp_path)).collect()] == [b"abc"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, f"u{k}", t, d, k * 10, k % 2) for k, (t, d) in enumerate([("red fox", "the red fox runs"), ("blue fox", "a fox"), ("red", "blue red fox"), ("", ""), ("Fox red", "nothing")])]
    return spark.createDataFrame(rows, "id long, url string, title string, description string, timestamp long, user_id long")


def ask(spark, index, **row):
    schema = {"must": "array<string>", "must_not": "array<string>", "phrase": "string", "ts_from": "long", "ts_to": "long"}
    q = spark.createDataFrame([(1, row.pop("text"), *row.values())], "query_id long, text string" + "".join(f", {c} {schema[c]}" for c in row))
    return [r.url for r in search.search(index, search.build_postings(index, ("title", "description")), q).orderBy("rank").collect()]


def test_search_forms(spark, index):
    assert set(ask(spark, index, text="fox")) == {"u0", "u1", "u2", "u4"}
    assert set(ask(spark, index, text="fox", must=["blue"])) == {"u1", "u2"}
    assert set(ask(spark, index, text="fox", must_not=["blue"])) == {"u0", "u4"}
    assert set(ask(spark, index, text="fox red", phrase="red fox")) == {"u0", "u2"}
    assert set(ask(spark, index, text="fox", phrase="")) == {"u0", "u1", "u2", "u4"}
    assert set(ask(spark, index, text="fox", ts_from=10, ts_to=20)) == {"u1", "u2"}
    assert ask(spark, index, text="absent") == []


def test_pages_join_to_the_whole_ranking(spark, index):
    p = search.build_postings(index, ("title", "description"))
    scores = search.scored(p, spark.createDataFrame([(1, "fox red")], "query_id long, text string"))
    whole = [(r.rank, r.id) for r in search.paged(scores, 0, 100).orderBy("rank").collect()]
    assert whole == [(r.rank, r.id) for k in range(3) for r in search.paged(scores, k, 2).orderBy("rank").collect()]


def test_updated_postings_are_rebuilt_ones(spark, index):
    new = index.filter("id < 2").withColumn("title", F.lit("green"))
    fields = ("title", "description")
    updated = search.update_postings(search.build_postings(index, fields), new, search.build_postings(new, fields))
    rebuilt = search.build_postings(index.filter("id >= 2").unionByName(new), fields)
    assert sorted(map(repr, updated.collect())) == sorted(map(repr, rebuilt.collect()))


def test_index_versions(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        tables.open_index(spark, path)
    fields = ("title", "description")
    assert tables.write_index(search.build_postings(index, fields), path) == 0
    old, stats = tables.open_index(spark, path)
    asked = spark.createDataFrame([(1, "fox red")], "query_id long, text string")
    want = sorted(map(tuple, search.scored(search.build_postings(index, fields), asked).collect()))
    assert sorted(map(tuple, search.scored(old, asked, stats=stats).collect())) == want
    assert tables.write_index(search.build_postings(index.filter("id < 2"), fields), path) == 1
    assert {r.id for r in tables.open_index(spark, path)[0].collect()} == {0, 1} and {r.id for r in old.collect()} == {0, 1, 2, 4}
    (tmp_path / "index" / "version-1" / "fields" / "_SUCCESS").unlink()  # a version that was not finished
    assert {r.id for r in tables.open_index(spark, path)[0].collect()} == {0, 1, 2, 4}


def test_added_users_and_files(spark, family):
    new = spark.createDataFrame([(11, 2, "a", 5, "", ""), (13, 2, "z", 5, "s", "i"), (12, 2, "z", 6, "t", "j")], "id long, parent_id long, username string, creation_datetime long, secret string, invite_secret string")
    out = accounts.add_users(family, new)
    assert out.count() == 11 and [tuple(r) for r in out.filter("username = 'z'").collect()] == [(12, 2, "z", 6, "t", "j", 0)]
    f = spark.createDataFrame([(1, "h", "a", 0, 1, 1)], schemas.FILES)
    more = spark.createDataFrame([(2, "h", "b", 0, 1, 1), (4, "g", "d", 0, 1, 1), (3, "g", "c", 0, 1, 0)], schemas.FILES)
    assert sorted(r.id for r in files.add_files(f, more).collect()) == [1, 3] and files.add_files(f, more.limit(0)).count() == 1


def test_sources_have_fixed_schemas(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "t", "b", 1, 5, True, bytearray(b"i"), "f.jpg", "index")], schemas.CAPTURES)
    rows.write.json(str(tmp_path / "json"))
    rows.write.parquet(str(tmp_path / "parquet"))
    assert [tuple(r) for r in tables.read_captures(spark, str(tmp_path / "parquet")).collect()] == [tuple(r) for r in rows.collect()]
    assert tables.read_captures(spark, str(tmp_path / "json"), "json").select("seq", "url", "op").collect() == rows.select("seq", "url", "op").collect()
    assert tables.read_table(spark, str(tmp_path / "parquet"), "url string, missing int").collect()[0].asDict() == {"url": "u", "missing": None}


def test_prompt(spark):
    df = spark.createDataFrame([("T", "u", True), ("T", "u", False)], "t string, u string, s boolean")
    got = [r.p for r in df.select(S.prompt(F.col("t"), F.col("u"), F.col("s")).alias("p")).collect()]
    assert got[0].startswith("Annotate the page u titled T. ") and got[1].startswith("Annotate the image captured at u. ")


def test_null_seq_hash_and_id_lose_no_row(spark):
    log = spark.createDataFrame([(None, "a", "index", 1), (None, "b", "index", 1), (2, "b", "delete", 1), (1, None, "index", 1), (5, None, "index", 2)], LOG)
    assert sorted(((r.url, r.seq) for r in changes.latest_by_url(log).collect()), key=repr) == sorted([("a", None), ("b", 2), (None, 5)], key=repr)
    assert sorted((r.url for r in changes.apply_log(log).collect()), key=repr) == sorted(["a", None], key=repr)
    once = changes.upsert(changes.latest_by_url(log), log)
    assert once.count() == changes.upsert(once, log).count() == 3
    f = spark.createDataFrame([(None, None, "x", 0, 1, 0), (2, None, "b", 0, 1, 0), (1, None, "a", 0, 1, 1), (None, "h", "y", 0, 1, 0)], schemas.FILES)
    got = sorted(((r.id, r.hash, r.stored_id, r.is_first) for r in files.file_dedup(f).collect()), key=repr)
    assert got == sorted([(None, None, 1, False), (2, None, 1, False), (1, None, 1, True), (None, "h", None, True)], key=repr)
    stored = files.first_files(f)
    assert sorted(r.filename for r in stored.collect()) == ["a", "y"]
    assert files.add_files(stored, f).count() == files.add_files(files.add_files(stored, f), f).count() == 2
    contents = spark.createDataFrame([(None, bytearray(b"x")), (None, bytearray(b"x")), (1, bytearray(b"y")), (2, None)], "id long, content binary")
    assert sorted(bytes(r.content) for r in tables.store_contents(contents).collect()) == [b"x", b"y"]


def test_long_digits_are_no_user(spark, family):
    who = spark.createDataFrame([("99999999999999999999",), ("9223372036854775808",), ("2",), (None,)], "ident string")
    assert [r.ident for r in accounts.resolve_users(who, family).collect()] == ["2"]
    new = spark.createDataFrame([(None, 2, "z", 5, "", ""), (12, 2, "z", 6, "", ""), (None, 2, None, 5, "", "")], "id long, parent_id long, username string, creation_datetime long, secret string, invite_secret string")
    once = accounts.add_users(family, new)
    assert sorted(((r.id, r.username) for r in once.collect() if r.username in (None, "z")), key=repr) == sorted([(12, "z"), (None, None)], key=repr)
    assert accounts.add_users(once, new).count() == once.count()


def test_open_time_bounds_and_shared_ids(spark, index):
    assert set(ask(spark, index, text="fox", ts_from=None, ts_to=20)) == {"u0", "u1", "u2"}
    assert set(ask(spark, index, text="fox", ts_from=20, ts_to=None)) == {"u2", "u4"}
    assert set(ask(spark, index, text="fox", ts_from=None, ts_to=None)) == {"u0", "u1", "u2", "u4"}
    both = index.unionByName(index.filter("id = 1").withColumns({"url": F.lit("again"), "timestamp": F.lit(99).cast("long")}))
    assert sorted(ask(spark, both, text="fox")) == ["again", "u0", "u2", "u4"]


def test_phrases_meet_in_one_field(spark):
    texts = ["a b a b c", "a b b c", "c a", "a x b c", "b c a b c a b", "", None, "the a b", "A, B! c?"]
    rows = [(k, f"u{k}", t, "a" if k == 2 else "none", k, 0) for k, t in enumerate(texts)]
    pages_ = spark.createDataFrame(rows, "id long, url string, title string, description string, timestamp long, user_id long")
    postings = search.build_postings(pages_, ("title", "description"))
    phrases = ["a b c", "b c a", "a a", "c a", "b", "a b a b", "missing a", "none a", "", None]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")
    stats = {"terms": search.term_stats(postings)}
    want = set()
    for q, phrase in enumerate(phrases):
        words = (phrase or "").split()
        for k, url, title, description, *_ in rows:
            for text in (title, description):
                have = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
                if words and any(have[i : i + len(words)] == words for i in range(len(have))):
                    want.add((q, k))
    for given in (None, stats):
        assert {(r.query_id, r.id) for r in search.having_phrase(postings, asked, given).collect()} == want
    plan = search.having_phrase(postings, asked, stats)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(positions" not in plan


def test_queries_without_hits_have_an_empty_list(spark, index):
    asked = spark.createDataFrame([(1, "fox"), (2, "absent"), (3, None)], "query_id long, text string")
    hits = search.search(index, search.build_postings(index, ("title",)), asked)
    got = {r.query_id: r.result for r in tables.to_result_json(hits, asked).collect()}
    assert got[2] == got[3] == '{"search_results":[]}' and "fox" in got[1] and len(got) == 3
