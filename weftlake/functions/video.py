"""Video and channel pages: what their embedded JSON holds, told by tables of paths."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

WATCH = "https://www.youtube.com/watch?v="
#: Where each field stands, alternatives in order. A name steps into an object, a number into a list; "*text"
#: joins the `text` of a list's members.
COMMENT = {
    "author": ("authorText.simpleText",),
    "text": ("contentText.runs.*text",),
    "likes": ("voteCount.simpleText",),
    "time": ("publishedTimeText.runs.*text",),
}
CHAPTER_TITLE = ("title.simpleText", "title.runs.*text")
RELATED = {
    "title": ("title.simpleText", "title.runs.*text"),
    "video_id": ("videoId",),
    "author": ("longBylineText.runs.0.text", "shortBylineText.runs.0.text"),
    "views": ("viewCountText.simpleText", "shortViewCountText.simpleText"),
}
GRID = {
    "title": ("title.simpleText", "title.runs.*text"),
    "video_id": ("videoId",),
    "views": ("viewCountText.simpleText", "shortViewCountText.simpleText"),
    "duration": ("thumbnailOverlays.0.thumbnailOverlayTimeStatusRenderer.text.simpleText",),
    "published": ("publishedTimeText.simpleText",),
}
RICH = {
    "title": ("title.runs.*text",),
    "video_id": ("videoId",),
    "views": ("viewCountText.simpleText", "shortViewCountText.simpleText"),
    "duration": ("lengthText.simpleText",),
    "published": ("publishedTimeText.simpleText",),
}
LOCKUP_TITLE = ("metadata.lockupMetadataViewModel.title.content",)
LOCKUP_ROWS = "metadata.lockupMetadataViewModel.metadata.contentMetadataViewModel.metadataRows"
LOCKUP_DURATION = ("contentImage.thumbnailViewModel.overlays.0.thumbnailBottomOverlayViewModel.badges.0.thumbnailBadgeViewModel.text",)
PUBLISHED_WORDS = ("ago", "month", "year", "day", "hour")
MAX_RELATED, MAX_VIDEOS, MAX_COMMENTS, SHOWN_COMMENTS = 10, 30, 20, 10

TYPE = (
    "struct<type:string,video_id:string,title:string,author:string,channel_id:string,views:long,duration:long,description:string,keywords:array<string>,is_live:boolean,image:string,"
    "chapters:array<struct<title:string,time:double>>,n_comments:long,comments:array<struct<author:string,text:string,likes:string,time:string>>,"
    "related:array<struct<title:string,video_id:string,author:string,views:string>>,handle:string,subscribers:string,video_count:string,banner:string,"
    "videos:array<struct<title:string,video_id:string,views:string,duration:string,published:string>>,markdown:string>"
)
FIELDS = re.findall(r"(?:struct<|,)(\w+):(?=string|long|boolean|array)", re.sub(r"array<struct<[^>]*>>", "array", TYPE))


def embedded(html: str, name: str):
    """The object of `var <name> = {...};` up to the first `};`, None where that is no JSON."""
    m = re.search(rf"var {name}\s*=\s*(\{{.+?\}});", html, re.S)
    try:
        return json.loads(m[1]) if m else None
    except (ValueError, RecursionError):
        return None


def under(root, key: str) -> Iterator:
    """All values of a key at any depth, parents before what they hold, in the order of the document. No recursion."""
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed([y for y in x if isinstance(y, dict | list)]))
        elif isinstance(x, dict):
            if key in x:
                yield x[key]
            stack.extend(reversed([y for y in x.values() if isinstance(y, dict | list)]))


def at(x, path: str):
    for step in path.split("."):
        if step == "*text":
            return "".join(str(r.get("text", "")) for r in x if isinstance(r, dict)) if isinstance(x, list) else None
        if isinstance(x, list):
            x = x[int(step)] if step.lstrip("-").isdigit() and -len(x) <= int(step) < len(x) else None
        else:
            x = x.get(step) if isinstance(x, dict) else None
    return x


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def first(x, paths: tuple[str, ...], default: str = "") -> str:
    return next((str(v) for p in paths if (v := at(x, p)) and not isinstance(v, dict | list)), default)


def _record(x, table: dict) -> dict:
    return {k: first(x, paths) for k, paths in table.items()}


def _number(x) -> int | None:
    """The whole number that a text or number begins with; None without one, and past 64 bits."""
    m = re.match(r"\s*[+-]?\d{1,19}(?!\d)", str(x)) if isinstance(x, str | int | float) and not isinstance(x, bool) else None
    n = int(m[0]) if m else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _seconds(millis) -> float | None:
    """None for what is no number, 0 for what is missing or empty."""
    try:
        t = float(millis or 0) / 1000 if isinstance(millis, str | int | float | None) and not isinstance(millis, bool) else math.nan
    except (ValueError, OverflowError):
        return None
    return t if math.isfinite(t) else None


def _span(seconds: int) -> str:
    h, rest = divmod(seconds, 3600)
    return f"{h}:{rest // 60:02d}:{rest % 60:02d}" if h > 0 else f"{rest // 60}:{rest % 60:02d}"


def _minutes(seconds: float | None) -> str:
    return "NaN:NaN" if seconds is None else f"{int(seconds // 60)}:{int(seconds % 60):02d}"


def _short(n: int) -> str:
    return next((f"{n / size:.1f}{unit}" for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")) if n >= size), str(n))


def _video_markdown(v: dict) -> str:
    views, span = ("NaN" if v["views"] is None else _short(v["views"])), ("NaN:NaN" if v["duration"] is None else _span(v["duration"]))
    blocks = [f"# {v['title'] or ''}\n", f"**{v['author'] or ''}** | {views} views | {span}\n"]
    if v["description"]:
        blocks.append(f"## Description\n\n{v['description']}\n")
    if v["keywords"]:
        blocks.append(f"**Tags:** {', '.join(v['keywords'])}\n")
    if v["chapters"]:
        blocks.append("## Chapters\n\n" + "".join(f"- **{_minutes(c['time'])}** — {c['title']}\n" for c in v["chapters"]))
    if v["comments"]:
        blocks.append(f"## Top Comments ({v['n_comments']})\n\n" + "\n".join(f"> **{c['author']}** ({c['likes']} likes, {c['time']})\n> {c['text']}\n" for c in v["comments"][:SHOWN_COMMENTS]))
    if v["related"]:
        blocks.append("## Related Videos\n\n" + "".join(f"- [{r['title']}]({WATCH}{r['video_id']}) — {r['author']} ({r['views']})\n" for r in v["related"]))
    return "\n".join(blocks)


def _channel_markdown(c: dict, known: bool) -> str:
    blocks = []
    if known:
        blocks.append(f"# {c['title']}\n")
        blocks.append(f"**{c['handle']}** | {c['subscribers']} | {c['video_count']}\n" if c["handle"] else "")
        if c["description"]:
            blocks.append(f"## About\n\n{c['description']}\n")
    if c["videos"]:
        line = lambda v: f"- [{v['title']}]({WATCH}{v['video_id']}) — {' | '.join(filter(None, (v['duration'], v['views'], v['published'])))}\n"
        blocks.append("## Videos\n\n" + "".join(map(line, c["videos"])))
    return "\n".join(blocks)


def _lockup(x) -> dict:
    out = {"title": first(x, LOCKUP_TITLE), "video_id": first(x, ("contentId",)), "views": "", "duration": first(x, LOCKUP_DURATION), "published": ""}
    rows = at(x, LOCKUP_ROWS)
    for row in rows if isinstance(rows, list) else []:
        parts = at(row, "metadataParts")
        for part in parts if isinstance(parts, list) else []:
            t = first(part, ("text.content",))
            if "view" in t:
                out["views"] = t
            elif any(w in t for w in PUBLISHED_WORDS):
                out["published"] = t
    return out


def videos_of(data) -> list[dict]:
    """A list's videos by the newest layout that gives any."""
    for found in (
        (v for v in map(_lockup, list(under(data, "lockupViewModel"))[:MAX_VIDEOS]) if v["video_id"]),
        (_record(x, GRID) for x in list(under(data, "gridVideoRenderer"))[:MAX_VIDEOS]),
        (_record(v, RICH) for x in list(under(data, "richItemRenderer"))[:MAX_VIDEOS] if (v := at(x, "content.videoRenderer"))),
    ):
        if out := list(found):
            return out
    return []


def extract(html: str, video_id: str) -> dict | None:
    """TYPE of a video page (its player's data) or a channel's or list's page; None for others. A value of another type than its field's is null."""
    player, data = embedded(html, "ytInitialPlayerResponse"), embedded(html, "ytInitialData")
    out = dict.fromkeys(FIELDS)
    video = at(player, "videoDetails")
    if isinstance(video, dict) and video:
        comments = [{**_record(r, COMMENT), "likes": first(r, COMMENT["likes"], "0")} for x in under(data, "commentThreadRenderer") if (r := at(x, "comment.commentRenderer"))]
        chapters = [{"title": first(c, CHAPTER_TITLE), "time": _seconds(at(c, "timeRangeStartMillis"))} for c in under(data, "chapterRenderer")]
        words = video.get("keywords") if isinstance(video.get("keywords"), list) else []
        out |= {"type": "video", "video_id": video_id, "title": _text(video.get("title")), "author": _text(video.get("author")), "channel_id": _text(video.get("channelId")), "views": _number(video.get("viewCount"))}
        out |= {"duration": _number(video.get("lengthSeconds")), "description": _text(video.get("shortDescription")), "keywords": [k for k in words if isinstance(k, str)], "is_live": live if isinstance(live := video.get("isLiveContent"), bool) else None}
        out |= {"image": _text(at(video, "thumbnail.thumbnails.-1.url")), "chapters": chapters, "n_comments": len(comments), "comments": comments[:MAX_COMMENTS]}
        out["related"] = [_record(x, RELATED) for x in list(under(data, "compactVideoRenderer"))[:MAX_RELATED]]
        out["markdown"] = _video_markdown(out)
        return out
    meta = next(under(data, "channelMetadataRenderer"), None)
    header = next(under(data, "c4TabbedHeaderRenderer"), None) or next(under(data, "pageHeaderRenderer"), None)
    out["videos"] = videos_of(data)
    if not (meta or header or out["videos"]):
        return None
    name = first(meta, ("title",)) or first(header, ("title",))
    out |= {"type": "channel", "title": name, "author": name, "handle": first(meta, ("vanityChannelUrl",)).rpartition("/")[2], "description": first(meta, ("description",))}
    out |= {"subscribers": first(header, ("subscriberCountText.simpleText",)), "video_count": first(header, ("videosCountText.runs.*text",))}
    out |= {"image": first(meta, ("avatar.thumbnails.-1.url",)), "banner": first(header, ("banner.thumbnails.-1.url",))}
    out["markdown"] = _channel_markdown(out, bool(meta or header))
    return out
