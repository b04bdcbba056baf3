"""Record and table schemas of the contract, version 1."""

from __future__ import annotations

CONTRACT_VERSION = 1
POST = "unique_id string, source string, source_type string, author string, description string, direct_link string, posted_at string, urls array<string>"
OBSERVATION = "normalized_url string, feed_url string, observed_at string, success boolean, status int, error string, etag string, last_modified string, latest_entry_at string, site_link string"
CHECKPOINT = "source_type string, source_key string, cursor string, observed_at string, source_url string"
BLUESKY_FOLLOW = "did string, handle string, display_name string"
MASTODON_FOLLOW = "account_id string, acct string, display_name string, url string"
MANIFEST = (
    "contract_version int, batch_id string, created_at string, collector_version string, collector_commit string, catalog_revision string, "
    "files array<struct<name:string,kind:string,record_count:int,sha256:string,scope:string,observed_at:string>>"
)
CATALOG = (
    "catalog_version int, revision string, generated_at string, source string, "
    "rss_feeds array<struct<feed_url:string,normalized_url:string>>, subreddits array<struct<name:string,normalized_name:string>>"
)
STATE = "state_version int, updated_at string, rss_cache map<string,struct<etag:string,last_modified:string>>, checkpoints map<string,map<string,struct<cursor:string,observed_at:string,source_url:string>>>"
#: Kind of record -> (file name, schema); the Mastodon file has its scope in the name.
KINDS = {
    "posts": ("posts.ndjson", POST),
    "rss_observations": ("rss-observations.ndjson", OBSERVATION),
    "checkpoints": ("checkpoints.ndjson", CHECKPOINT),
    "bluesky_follows": ("bluesky-follows.ndjson", BLUESKY_FOLLOW),
    "mastodon_follows": ("mastodon-follows-*.ndjson", MASTODON_FOLLOW),
}
#: Keys whose value may be null; all keys of a kind have to be there.
NULLABLE = {
    "posts": (),
    "rss_observations": ("status", "error", "etag", "last_modified", "latest_entry_at", "site_link"),
    "checkpoints": ("source_url",),
    "bluesky_follows": ("display_name",),
    "mastodon_follows": ("display_name", "url"),
}
#: Fixed value: how an instant is written in a record.
INSTANT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
HEALTH = (  # times without zone: UTC throughout
    "normalized_url string, last_fetched_at timestamp_ntz, last_success_at timestamp_ntz, last_status int, last_error string, consecutive_failures int, "
    "etag string, last_modified string, latest_entry_at timestamp_ntz, site_link string"
)
