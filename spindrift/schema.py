"""Table schemas, ordered enums and the fixed parameters of scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVENT = struct(
    event_id=L, stable_id=S, source=S, scope_kind=S, owner=L, event_time=TS, ingest_time=TS, title=S, body=S, links=T.ArrayType(S),
    group_key=S, entities=T.ArrayType(S), content_kind=S, severity=I, connection_id=L,
)
CLUSTER = struct(
    cluster_id=S, scope_kind=S, owner=L, source=S, group_key=S, title=S, link=S, first_event_time=TS, last_event_time=TS, entities=T.ArrayType(S),
    event_count=L, depth_rank=I, max_severity=I, connection_id=L, updated_at=TS,
)
PRIOR_MEMBER = struct(subscriber=L, cluster_id=S, story_id=S, delivered=B)
DIGEST = struct(digest_id=L, subscriber=L, window_end=TS, delivered_at=TS)
DIGEST_ITEM = struct(digest_id=L, story_id=S, position=I, thread_id=S, story_last_event_time=TS, format=S)
THREAD = struct(thread_id=S, subscriber=L, origin=S, state=S, pinned=B, entities=T.ArrayType(S), affinity=D, first_seen=TS, last_story_time=TS)
EDGE = struct(scope_kind=S, owner=L, a=S, b=S, confidence=D, source=S)
FEEDBACK = struct(subscriber=L, target_type=S, target_id=S, signal=S, created_at=TS)

#: Kinds of content from the thinnest on; their order isn't that of their names.
CONTENT_KINDS = ("message", "announcement", "longform")


def depth_rank(kind: Column) -> Column:
    return F.when(kind == "longform", 2).when(kind == "announcement", 1).otherwise(0)


def depth_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONTENT_KINDS)), rank + 1)


@dataclass(frozen=True)
class Scoring:
    """Defaults of a digest's configuration."""

    relevance_floor: float = 0.0
    scope_bonus: float = 0.5
    severity_weight: float = 0.1
    recency_half_life_days: float = 3.0
    salience_half_life_days: float = 7.0
    thread_half_life_days: float = 21.0
    story_cap: int = 5
    note_cap: int = 20
    thread_cap: int = 2
    resurface_penalty: float = 0.25
    resurface_cap: int = 5
    max_items: int = 25


# Fixed values of linking, identity and threads.
W_JACCARD, W_TEMPORAL = 0.7, 0.3
WEAK_THRESHOLD, WEAK_MIN_JACCARD = 0.35, 0.2
SATURATED, SATURATED_MIN_WEIGHT = 0.999, 1.2
TEMPORAL_WINDOW_DAYS = 14.0
MAX_LOOKBACK_DAYS, HORIZON_DAYS = 90, 30
THETA, LEXICAL_THRESHOLD, LEXICAL_MOST = 0.8, 0.8, 0.95
CONFIRMED, PROBABLE = 0.99, 0.75
DORMANT_DAYS, ARCHIVE_DAYS, AFFINITY_HALF_LIFE_DAYS = 21, 90, 30
MATCH_THRESHOLD, AFFINITY_MAX = 0.3, 10.0
POLL_BACKOFF_MOST_SECS, POLL_FAILURES_MOST = 86_400, 5
