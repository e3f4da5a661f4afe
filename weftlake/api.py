"""What a user calls: page records, crawls, site maps, searches, reading, discovery and tracking over tables of snapshots."""

from __future__ import annotations

from .functions.text import content_hash, content_key, plain_text, reduction, token_estimate
from .functions.urls import file_name, frontier_key, mention_key, search_key
from .operators.adaptive import adaptive as fetch
from .operators.browse import browse
from .operators.chunk import chunk
from .operators.page import agent_extract, extract_many, parse
from .operators.plugins import Plugin
from .operators.ranking import exact_dedup, rrf, seeds, tier_memory
from .operators.site import crawl_site, map_site, scrape
from .operators.track import digest_text, mentions, new_mentions, prune, reach, track
from .sources.results import discover, discover_domains, hits, reader, search, video_pages
from .sources.state import as_json, evict, lookup, pace, read_state, rotate, watchlist, write_results, write_state

__all__ = [
    "Plugin", "agent_extract", "as_json", "browse", "chunk", "content_hash", "content_key", "crawl_site", "digest_text", "discover",
    "discover_domains", "evict", "exact_dedup", "extract_many", "fetch", "file_name", "frontier_key", "hits", "lookup", "map_site", "mention_key",
    "mentions", "new_mentions", "pace", "parse", "plain_text", "prune", "reach", "read_state", "reader", "reduction", "rotate", "rrf",
    "scrape", "search", "search_key", "seeds", "tier_memory", "token_estimate", "track", "video_pages", "watchlist", "write_results", "write_state",
]
