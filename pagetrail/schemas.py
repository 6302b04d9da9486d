"""Fixed schemas of the sources; none is inferred."""

from pyspark.sql import types as T

CAPTURES = "seq long, url string, title string, body string, user_id long, ts long, stored boolean, image binary, image_filename string, op string"
PAGE_INDEX = (
    "id decimal(20,0), url string, title string, description string, direct_keywords string, related_keywords string, "
    "timestamp long, user_id long, image_hash string, image_filename string"
)
USERS = "id long, parent_id long, username string, creation_datetime long, secret string, invite_secret string, invite_counter int"
SESSIONS = "key string, host string, user_id long, creation_datetime long, expires_at_datetime long"
FILES = "id long, hash string, filename string, creation_datetime long, size long, is_public int"
ANNOTATION = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("direct_keywords", T.ArrayType(T.StringType())),
    T.StructField("related_keywords", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
])
TEXT_FIELDS = ("title", "description", "direct_keywords", "related_keywords")
EVENTS_LOG = "seq long, page_id long, url string, user_id long, ts long, op string"
REQUESTS = "request_id long, user_id long, ts long, session_key string"
