"""Tables of the feed and resource library: types, keys, references and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hidden feed that holds saved pages; it is never listed, fetched or removed.
CLIPPINGS_URL = "local://web-clippings"
CLIPPINGS_TITLE = "Web clippings"

_L, _S, _B, _I = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType()
_LIST = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "feeds": _table(id=_L, url=_S, title=_S, interval_secs=_L, last_fetch=_L, next_fetch=_L, last_error=_S, fail_count=_L, disabled=_B),
    "articles": _table(id=_L, feed_id=_L, entry_id=_S, url=_S, title=_S, author=_S, published=_L, content=_S, is_read=_B, starred=_B, read_later=_B, archived=_B, fetched_at=_L),
    "article_selections": _table(id=_L, article_id=_L, selected_text=_S, start_offset=_L, end_offset=_L, anchor_prefix=_S, anchor_suffix=_S, comment=_S, is_favorite=_B, created_at=_L, updated_at=_L),
    "tags": _table(id=_L, name=_S, created_at=_L),
    "article_tags": _table(article_id=_L, tag_id=_L, created_at=_L),
    "article_ai": _table(article_id=_L, summary_zh=_S, translation_zh=_S, model=_S, updated_at=_L),
    "search_history": _table(query=_S, last_used_at=_L, use_count=_L, result_count=_L),
    "resources": _table(
        id=_L, url=_S, canonical_url=_S, parent_resource_id=_L, linked_article_id=_L, kind=_S, title=_S, purpose_zh=_S, purpose_source=_S, use_when_zh=_S, use_when_source=_S, capabilities=_LIST,
        limitations=_LIST, pricing=_S, requires_login=_B, languages=_LIST, private_note=_S, privacy=_S, status=_S, source=_S, manual_rating=_L, latest_snapshot_id=_L, last_checked_at=_L, created_at=_L, updated_at=_L,
    ),
    "resource_categories": _table(resource_id=_L, category=_S),
    "resource_tags": _table(resource_id=_L, name=_S, language=_S, source=_S, created_at=_L),
    "resource_snapshots": _table(id=_L, resource_id=_L, content_hash=_S, fetched_url=_S, http_status=_L, title=_S, cleaned_content=_S, fetched_at=_L, fetch_error=_S),
    "resource_enrichment_runs": _table(id=_L, resource_id=_L, snapshot_id=_L, provider=_S, model=_S, prompt_version=_S, schema_version=_S, started_at=_L, finished_at=_L, status=_S, error_code=_S, error_message=_S),
    "resource_usage_events": _table(id=_L, resource_id=_L, event=_S, occurred_at=_L),
}

KEYS = {name: ["id"] for name in TABLES} | {"article_tags": ["article_id", "tag_id"], "article_ai": ["article_id"], "search_history": ["query"], "resource_categories": ["resource_id", "category"], "resource_tags": ["resource_id", "name"]}

#: (table, column, referenced table): each value must be null or an id there.
REFERENCES = [
    ("articles", "feed_id", "feeds"), ("article_selections", "article_id", "articles"), ("article_tags", "article_id", "articles"), ("article_tags", "tag_id", "tags"), ("article_ai", "article_id", "articles"),
    ("resources", "parent_resource_id", "resources"), ("resources", "linked_article_id", "articles"), ("resource_categories", "resource_id", "resources"), ("resource_tags", "resource_id", "resources"),
    ("resource_snapshots", "resource_id", "resources"), ("resource_enrichment_runs", "resource_id", "resources"), ("resource_usage_events", "resource_id", "resources"),
]

# The vocabularies of enumerated columns.
VOCABULARY = {
    ("resources", "kind"): ["site", "page", "article"],
    ("resources", "privacy"): ["public", "private"],
    ("resources", "status"): ["pending_review", "enrichment_pending", "active", "broken", "archived"],
    ("resources", "source"): ["gui", "cli_agent", "import"],
    ("resources", "pricing"): ["free", "freemium", "paid", "unknown"],
    ("resource_categories", "category"): ["tool", "asset-library", "docs", "blog", "inspiration", "service", "repository", "other"],
    ("resource_tags", "source"): ["manual", "ai"],
    ("resource_tags", "language"): ["zh", "en", "other"],
    ("resource_enrichment_runs", "status"): ["pending", "running", "succeeded", "failed"],
    ("resource_usage_events", "event"): ["returned", "confirmed_used"],
}

# Allowed status changes of a resource.
TRANSITIONS = [
    ("pending_review", "active"), ("pending_review", "archived"), ("enrichment_pending", "active"), ("enrichment_pending", "enrichment_pending"), ("active", "broken"),
    ("active", "archived"), ("broken", "active"), ("broken", "archived"), ("archived", "active"),
]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns: missing ones are null (flags false, counters 0), others are dropped."""
    defaults = {"is_read": False, "starred": False, "read_later": False, "archived": False, "disabled": False, "is_favorite": False, "fail_count": 0, "next_fetch": 0, "use_count": 1, "result_count": 0, "anchor_prefix": "", "anchor_suffix": ""}
    out = []
    for f in TABLES[table].fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit(defaults[f.name])) if f.name in defaults else value).cast(f.dataType).alias(f.name))
    return df.select(*out)


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside its vocabulary, and which column it is."""
    wrong = [F.when(~F.col(c).isin(words), F.lit(c)) for (t, c), words in VOCABULARY.items() if t == table and c in df.columns]
    if not wrong:
        return df.withColumn("column", F.lit(None).cast("string")).limit(0)
    return df.withColumn("column", F.coalesce(*wrong)).filter("column is not null")
