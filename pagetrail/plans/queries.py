"""A registered query for every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail import schemas
from pagetrail.functions import scalars as S
from pagetrail.operators import accounts as A
from pagetrail.operators import blocks as K
from pagetrail.operators import changes as C
from pagetrail.operators import files as FI
from pagetrail.operators import pages as P
from pagetrail.operators import search as Q
from pagetrail.operators import tree as T
from pagetrail.plans import views as V
from pagetrail.sources import contents as N
from pagetrail.sources import increments as I
from pagetrail.sources import tables as R
from pagetrail.sources.scratch import fresh_path, written
from pagetrail.streaming import jobs as J

FIELDS = schemas.TEXT_FIELDS
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def page_text(spark: SparkSession, d: str) -> DataFrame:
    x = V.extracted(spark, d)
    return x.select("page_id", "url", "title", "h1", "body", P.description(F.col("body")).alias("description"), P.title_choice(F.col("title"), F.col("h1"), F.col("url")).alias("shown_title"))


@query
def page_ids(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.page_id(F.col("url")).alias("id"), S.url_origin(F.col("url")).alias("origin"))


@query
def page_tokens(spark, d):
    return V.extracted(spark, d).select("page_id", F.posexplode(S.tokens(F.col("body"))).alias("pos", "term")).select("page_id", "pos", "term")


def _postings(spark, d):
    return Q.build_postings(V.records(spark, d), FIELDS)


@query
def postings(spark, d):
    path = fresh_path(spark, "index")
    R.write_index(_postings(spark, d), path)
    return R.open_index(spark, path)[0].select("field", "term", "id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query
def corpus_stats(spark, d):
    path = fresh_path(spark, "index")
    R.write_index(_postings(spark, d), path)
    _, stats = R.open_index(spark, path)
    return stats["terms"].join(stats["fields"], "field").select("field", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def _direct(spark, d):
    return P.direct_keywords(V.index(spark, d), "id", "body")


@query
def direct_keywords(spark, d):
    return _direct(spark, d).select("id", "term", "weight", "rank")


@query
def related_keywords(spark, d):
    _, c = V.index_and_corpus(spark, d)
    return P.related_keywords(c["direct"], c["counts"], partners=c["partners"]).select("id", "term", "weight", "rank")


@query
def page_records(spark, d):
    last = C.latest_by_url(V.captures(spark, d).filter("op = 'index'")).select("url", "ts", "user_id", F.col("seq").alias("last_seq"))
    pages = C.latest_by_url(V.table(spark, d, "pages").withColumn("seq", F.col("page_id"))).join(last, "url")
    pages = written(P.extract_text(pages).withColumn("id", S.page_id(F.col("url"))), "pages")
    c = V.corpus(pages)
    stored = F.col("page_id") % 2 == 0
    full = P.with_keywords(pages, c["direct"], P.related_keywords(c["direct"], c["counts"], partners=c["partners"]))
    full = full.withColumns({"captured_title": F.col("url"), "stored": stored, "image": F.col("html").cast("binary"), "image_filename": F.when(stored, F.concat(F.col("page_id").cast("string"), F.lit(".jpg")))})
    return P.page_records(full)


def _stored(spark, d):
    """(records, postings, statistics with blocks) of an index written and opened again."""
    idx, path = V.records(spark, d), fresh_path(spark, "index")
    R.write_index(Q.build_postings(idx, FIELDS), path, pages=idx)
    return idx, *R.open_index(spark, path)


def _search(spark, d, columns=(), **how):
    idx, p, stats = _stored(spark, d)
    asked = V.queries(idx).select("query_id", "text", *columns)
    return Q.search(idx, p, asked, stats=stats, **how)


@query
def search_any(spark, d):
    return _search(spark, d, size=15)


@query
def search_topk(spark, d):
    idx, _, stats = _stored(spark, d)
    asked = V.queries(idx).select("query_id", "text")
    return K.best(stats, Q.query_terms(asked), asked, 10).orderBy(F.desc("score"), "query_id", "id").limit(10)


@query
def search_page2(spark, d):
    return _search(spark, d, page=1, size=15)


@query
def search_fields(spark, d):
    return _search(spark, d, fields=("title",), size=15)


@query
def search_must(spark, d):
    return _search(spark, d, ("must",), size=15)


@query
def search_must_not(spark, d):
    return _search(spark, d, ("must_not",), size=15)


@query
def search_phrase(spark, d):
    return _search(spark, d, ("phrase",), size=15)


@query
def search_time(spark, d):
    return _search(spark, d, ("ts_from", "ts_to"), size=15)


@query
def search_json(spark, d):
    idx, p, stats = _stored(spark, d)
    asked = V.queries(idx).select("query_id", "text")
    return R.to_result_json(Q.search(idx, p, asked, stats=stats, size=15), asked)


@query
def lookup_url(spark, d):
    urls = V.captures(spark, d).filter("seq % 100 = 0").select("url")
    return C.get_by_url(V.index(spark, d), urls).select("id", "url", "title")


@query
def latest_by_url(spark, d):
    return C.latest_by_url(V.captures(spark, d))


@query
def upsert_pages(spark, d):
    log = V.captures(spark, d).filter("op = 'index'")
    return C.upsert(C.latest_by_url(log.filter("seq % 2 = 0")), log.filter("seq % 2 = 1"))


@query
def apply_log(spark, d):
    return C.apply_log(V.captures(spark, d))


@query
def delete_by_url(spark, d):
    log = V.captures(spark, d)
    return C.delete_by_url(C.latest_by_url(log.filter("op = 'index'")), log.filter("op = 'delete'"))


@query
def update_postings(spark, d):
    idx = V.records(spark, d)
    p = Q.build_postings(idx, FIELDS)
    changed = idx.filter("page_id % 7 = 3").withColumns({"title": F.concat("title", F.lit(" "), "description"), "description": F.col("title")})
    return Q.update_postings(p, changed, Q.build_postings(changed, FIELDS)).select("field", "term", "id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def _changed(spark, d):
    """(pages as they are now, queries, postings, statistics): an index with blocks, changed twice after it was written.

    Pages whose number leaves 5 of 7 are deleted; those that leave 3 have title and description exchanged, and
    before that the title twice.
    """
    idx, path = V.records(spark, d), fresh_path(spark, "index")
    R.write_index(Q.build_postings(idx, FIELDS), path, pages=idx)
    left = F.col("page_id") % 7
    first = idx.filter(left == 3).withColumn("description", F.col("title"))
    I.change_index(spark, path, first.select("id"), Q.build_postings(first, FIELDS), idx)
    touched = idx.filter(left.isin(3, 5))
    last = idx.filter(left == 3).withColumns({"title": F.concat("title", F.lit(" "), "description"), "description": F.col("title")})
    I.change_index(spark, path, touched.select("id"), Q.build_postings(last, FIELDS), idx)
    return idx.filter(~left.isin(3, 5)).unionByName(last), V.queries(idx).select("query_id", "text"), *R.open_index(spark, path)


@query
def changed_stats(spark, d):
    _, _, _, stats = _changed(spark, d)
    return stats["terms"].join(stats["fields"], "field").select("field", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query
def changed_postings(spark, d):
    return _changed(spark, d)[2].select("field", "term", "id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query
def changed_search(spark, d):
    now, asked, p, stats = _changed(spark, d)
    return Q.search(now, p, asked, stats=stats, size=15)


@query
def recent_captures(spark, d):
    return C.recent_captures(V.captures(spark, d))


def _resolved(spark, d):
    return A.resolve_sessions(V.requests(spark, d), V.sessions(spark, d), V.users(spark, d), V.hosts(spark), V.AS_OF)


@query
def session_users(spark, d):
    return _resolved(spark, d)


@query
def valid_at_request(spark, d):
    return A.valid_at_request(V.requests(spark, d), V.sessions(spark, d))


@query
def access_decision(spark, d):
    return A.classify_access(_resolved(spark, d), V.LOCAL, allow_foreign=False, admin_only=True)


@query
def user_lookup(spark, d):
    e = V.events(spark, d)
    ident = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return A.resolve_users(e.select(ident.alias("ident")).distinct(), V.users(spark, d)).select("ident", "id", "username")


@query
def key_lookup(spark, d):
    keys = V.requests(spark, d).select(S.session_parts(F.col("session_key"))["key"].alias("key"))
    return A.lookup(V.sessions(spark, d), "key", keys)


@query
def user_listing(spark, d):
    return A.public_users(V.users(spark, d))


@query
def redacted_users(spark, d):
    return A.redact(V.users(spark, d))


@query
def valid_names(spark, d):
    u = V.users(spark, d).withColumn("username", F.when(F.col("id") % 4 == 0, F.concat("username", F.lit(" x"))).otherwise(F.col("username")))
    return A.valid_names(u).select("id", "username", "valid")


@query
def child_counts(spark, d):
    return T.child_counts(V.users(spark, d))


@query
def tree_stats(spark, d):
    return T.tree_stats(V.users(spark, d))


@query
def tree_depth(spark, d):
    return T.depths(V.users(spark, d))


@query
def descendants(spark, d):
    u = V.users(spark, d)
    return T.descendants(u, u.filter("id % 40 = 3").select("id"))


@query
def tree_parents(spark, d):
    return T.attached(V.users(spark, d))


def _deleted(spark, d, recursive):
    u = V.users(spark, d)
    left, live, n = T.delete_users(u, V.sessions(spark, d), u.filter("id % 40 = 3").select("id"), recursive)
    counts = live.agg(F.count(F.lit(1)).alias("sessions_left")).crossJoin(F.broadcast(n))  # one row each
    return left.select("id", "parent_id").crossJoin(F.broadcast(counts))


@query
def delete_one(spark, d):
    return _deleted(spark, d, False)


@query
def delete_tree(spark, d):
    return _deleted(spark, d, True)


@query
def bump_counters(spark, d):
    uses = V.events(spark, d).filter("event_type = 'signup'").select(F.col("user_id").alias("id"))
    return A.bump_counters(V.users(spark, d), uses).select("id", "invite_counter")


@query
def add_sessions(spark, d):
    new = V.events(spark, d).filter("event_type = 'purchase'").select(F.sha2(F.concat(F.lit("p"), F.col("event_id").cast("string")), 256).alias("key"), F.lit(V.LOCAL).alias("host"), "user_id", F.col("at").alias("creation_datetime"))
    return A.add_sessions(V.sessions(spark, d), new)


@query
def add_users(spark, d):
    new = V.table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("username"), F.lit(V.AS_OF).cast("long").alias("creation_datetime"), F.col("s_name").alias("secret"), F.lit("").alias("invite_secret"))
    return A.add_users(V.users(spark, d), new).select("id", "parent_id", "username", "creation_datetime", "invite_counter")


@query
def add_files(spark, d):
    """Uploads of the odd half on top of the even half: a hash that is there already adds nothing."""
    f = V.files(spark, d).withColumn("creation_datetime", F.lit(V.AS_OF).cast("long")).select("id", "hash", "filename", "creation_datetime", "size", "is_public")
    return FI.add_files(FI.first_files(f.filter("id % 2 = 0")), f.filter("id % 2 = 1")).select("id", "hash", "filename", "size", "is_public")


@query
def live_sessions(spark, d):
    return A.on_hosts(A.unexpired(V.sessions(spark, d), V.AS_OF), V.hosts(spark))


@query
def age_labels(spark, d):
    return V.users(spark, d).select("id", S.age_label(F.col("creation_datetime"), F.lit(1_704_067_200 + 60 * 86_400)).alias("label"))


@query
def file_dedup(spark, d):
    return FI.file_dedup(V.files(spark, d))


@query
def visible_files(spark, d):
    return FI.visible_files(V.files(spark, d), True).select("id", "hash", "filename", "size")


@query
def file_access(spark, d):
    asked = V.events(spark, d).select(F.col("event_id").alias("request_id"), (F.col("event_id") * 3).alias("file_id"), (F.col("event_type") == "click").alias("valid"))
    return FI.file_access(asked, V.files(spark, d)).select("request_id", "file_id", "decision")


@query
def stored_contents(spark, d):
    """Contents put on top of an earlier upload of every tenth: what is new, read back from the store."""
    f, path = V.files(spark, d), fresh_path(spark, "contents")
    known = written(N.put_contents(f.filter("id % 10 = 0"), path), "known")
    new = written(N.put_contents(f, path), "put").join(known, "hash", "left_anti")
    there = R.read_contents(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("hash"), F.sha2("content", 256).alias("content_hash"))
    return new.join(there, "hash").select("hash", "size", "content_hash")


@query
def chained_hash(spark, d):
    return V.files(spark, d).select("id", S.chained_hash(F.col("content"), 1024).alias("chained"))


@query
def annotation_parse(spark, d):
    """JSON built from the events: one in five is cut short and must land among the dead letters."""
    e = V.events(spark, d)
    whole = F.to_json(F.struct(F.col("event_type").alias("title"), F.array("event_type", F.col("user_id").cast("string")).alias("direct_keywords")))
    text = F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    good, bad = R.parse_annotations(e.select("event_id", text.alias("answer")), "answer")
    a = F.col("annotation")
    rows = good.select("event_id", S.or_default(a["title"]).alias("title"), S.joined_words(a["direct_keywords"]).alias("direct_keywords"), S.joined_words(a["related_keywords"]).alias("related_keywords"), S.or_default(a["description"]).alias("description"), F.lit(True).alias("parsed"))
    return rows.unionByName(bad.select("event_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "direct_keywords", "related_keywords", "description")], F.lit(False).alias("parsed")))


@query
def annotate_hook(spark, d):
    def model(frames):
        for pdf in frames:
            yield pdf.assign(answer=[f'{{"title": "{len(p)}", "direct_keywords": ["page"]}}' for p in pdf["prompt"]])[["page_id", "answer"]]

    asked = V.extracted(spark, d).select("page_id", S.prompt(F.col("title"), F.col("url"), F.col("page_id") % 2 == 0).alias("prompt"))
    good, _ = R.parse_annotations(P.annotate(asked, model, "page_id long, answer string"), "answer")
    return good.select("page_id", F.col("annotation.title").alias("title"), S.joined_words(F.col("annotation.direct_keywords")).alias("direct_keywords"))


def _as_files(df: DataFrame, order: str, parts: int = 4) -> str:
    """df as files of ascending order, for a stream to read one after the other."""
    path = fresh_path(df.sparkSession, "arrivals")
    df.repartitionByRange(parts, order).write.parquet(path)
    return path


@query
def read_table(spark, d):
    """Columns of the documents by a schema of their own; nothing is inferred."""
    return R.read_table(spark, f"{d}/documents.parquet", "doc_id long, lang string, source string, n_chars long")


@query
def read_captures(spark, d):
    """Captures written as JSON lines and read by the fixed schema of captures."""
    path = fresh_path(spark, "captures")
    image = F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))
    V.captures(spark, d).select("seq", "url", "user_id", "ts", "op", (F.col("page_id") % 2 == 0).alias("stored"), image.alias("image_filename")).write.json(path)
    return R.read_captures(spark, path, "json").select("seq", "url", "user_id", "ts", "op", "stored", "image_filename")


def _document_files(spark, d):
    """Files of a thousand documents of a source at most, a line each."""
    path, part = fresh_path(spark, "files"), F.expr("doc_id div 1000")
    lines = V.table(spark, d, "documents").select("source", part.alias("part"), "doc_id", F.translate(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "\r\n", "").alias("value"))
    lines.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").select("source", "part", "value").write.partitionBy("source", "part").text(path)
    source, number = (F.regexp_extract("path", "/source=([^/]*)/part=([0-9]+)/", k) for k in (1, 2))
    return path, source.alias("source"), number.cast("long").alias("part")


@query
def read_contents(spark, d):
    """Files of a thousand documents of a source at most, read whole."""
    path, source, number = _document_files(spark, d)
    return R.read_contents(spark, path, "part-*").select(source, number, "length", F.sha2("content", 256).alias("content_hash"))


@query
def chained_files(spark, d):
    """Chained hashes of the same files, read by ranges; no row holds a file."""
    path, source, number = _document_files(spark, d)
    return N.chained_files(spark, path, "part-*", 4096).select(source, number, "length", "chained")


@query
def stream_log(spark, d):
    log = V.captures(spark, d)
    stream = R.read_capture_stream(spark, _as_files(log, "seq"), schema=schemas.EVENTS_LOG)
    return J.run_log(stream, fresh_path(spark, "stream"), schemas.EVENTS_LOG)


INGESTED = "id decimal(20,0), url string, title string, description string, direct_keywords string, related_keywords string, timestamp long, user_id long, seq long"


def _ingested(spark, d):
    """Captures annotated and indexed as they come; keywords rest on the corpus of all pages."""
    _, c = V.index_and_corpus(spark, d)
    html = written(C.latest_by_url(V.table(spark, d, "pages").withColumn("seq", F.col("page_id"))).select("url", "html"), "html")
    stream = R.read_capture_stream(spark, _as_files(V.captures(spark, d), "seq"), schema=schemas.EVENTS_LOG)

    def records(new: DataFrame) -> DataFrame:
        pages = written(P.extract_text(new.join(html, "url")).withColumn("id", S.page_id(F.col("url"))), "extracted")
        counts = P.term_counts(pages, "id", "body")
        direct = written(P.weighted_terms(counts, c["terms"]), "direct")
        full = P.with_keywords(pages, direct, P.related_keywords(direct, counts, partners=c["partners"]))
        shown = P.title_choice(F.col("title"), F.col("h1"), F.lit(None).cast("string"))
        return full.select("id", "url", shown.alias("title"), P.description(F.col("body")).alias("description"), "direct_keywords", "related_keywords", F.col("ts").alias("timestamp"), "user_id", "seq")

    return J.run_ingest(stream, fresh_path(spark, "stream"), records, INGESTED, FIELDS)


@query
def stream_ingest(spark, d):
    return _ingested(spark, d)[0]


@query
def stream_postings(spark, d):
    return _ingested(spark, d)[1].select("field", "term", "id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query
def stream_recent(spark, d):
    stream = R.read_capture_stream(spark, _as_files(V.captures(spark, d), "seq"), schema=schemas.EVENTS_LOG)
    return J.run_recent(stream, fresh_path(spark, "stream"), schemas.EVENTS_LOG)


@query
def stream_sessions(spark, d):
    stream = R.read_capture_stream(spark, _as_files(V.requests(spark, d), "request_id"), schema=schemas.REQUESTS)
    return J.run_sessions(stream, fresh_path(spark, "stream"), V.sessions(spark, d))


def _in_time(df: DataFrame, order: str, parts: int = 4) -> tuple[str, int]:
    """df as files that come in parts of ascending time, and the longest time that a part spans."""
    path = fresh_path(df.sparkSession, "arrivals")
    ends = sorted(set(df.approxQuantile(order, [k / parts for k in range(parts + 1)], 0.001)))
    df.limit(0).write.parquet(path)
    for low, high in zip(ends, [*ends[1:], float("inf")], strict=True):
        df.filter((F.col(order) >= low) & (F.col(order) < high)).write.mode("append").parquet(path)
    return path, int(max((b - a for a, b in zip(ends, ends[1:], strict=False)), default=0)) + 1


@query
def stream_valid(spark, d):
    """Requests and sessions both arrive as files, late by a part of the time at most."""
    asked, slow = _in_time(V.requests(spark, d), "ts")
    live, slower = _in_time(V.sessions(spark, d), "creation_datetime")
    streams = (R.read_capture_stream(spark, p, schema=kind) for p, kind in ((asked, schemas.REQUESTS), (live, schemas.SESSIONS)))
    return J.run_valid(*streams, fresh_path(spark, "stream"), delay=max(slow, slower))
