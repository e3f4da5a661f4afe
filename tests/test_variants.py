"""Embedded JSON as VARIANT against the Python reader, well-formed and not."""

import json

from weftlake.functions import video
from weftlake.sources import variants

FIELDS = ("type", "title", "author", "channel_id", "views", "duration", "description", "keywords", "is_live", "image", "n_comments")


def page(details, data):
    raw = lambda x: x if isinstance(x, str) else json.dumps(x)
    return f"<script>var ytInitialPlayerResponse = {raw(details)};</script><script>var ytInitialData = {raw(data)};</script>"


def thread(text, **more):
    return {"commentThreadRenderer": {"comment": {"commentRenderer": {"authorText": {"simpleText": "me"}, "contentText": {"runs": [{"text": text}, {"text": "!"}, {"x": 1}]}, **more}}}}


GOOD = {"title": "T", "author": "A", "channelId": "c", "viewCount": "12", "lengthSeconds": 61, "shortDescription": "d", "keywords": ["a", "b"], "isLiveContent": False, "thumbnail": {"thumbnails": [{"url": "1"}, {"url": "2"}]}}
ODD = [{"title": 5}, {"viewCount": "9" * 30}, {"viewCount": str(2**63 - 1)}, {"viewCount": True}, {"viewCount": 1.5}, {"viewCount": " 12 views"}, {"isLiveContent": "yes"}, {"keywords": ["a", 5, None]}, {"keywords": "a"}, {"lengthSeconds": {}}, {"thumbnail": {"thumbnails": "x"}}, {"thumbnail": {"thumbnails": [{"url": 3}]}}, {"thumbnail": {"thumbnails": []}}, {"shortDescription": None}]
NEST = {"a": 1}
for _ in range(30):
    NEST = {"deep": [NEST, {"chapterRenderer": {"title": {"runs": [{"text": "x"}, {"text": "y"}]}, "timeRangeStartMillis": 1500}}]}
DATA = [
    {"x": [thread(f"t{i}", voteCount={"simpleText": str(i)}) for i in range(25)], "y": [{"compactVideoRenderer": {"title": {"simpleText": f"r{i}"}, "videoId": f"v{i}"}} for i in range(12)]},
    {"z": [{"chapterRenderer": {"title": {"simpleText": "one"}, "timeRangeStartMillis": t}} for t in ("abc", 61000, None, [1], "1e999", "2500", True)]},
    NEST, [], "nothing", {"commentThreadRenderer": {"comment": 5}}, {"commentThreadRenderer": thread("outer", inner=thread("held"))["commentThreadRenderer"]},
]
PAGES = [page({"videoDetails": {**GOOD, **o}}, DATA[0]) for o in ODD] + [page({"videoDetails": GOOD}, x) for x in DATA] + [page({"videoDetails": x}, DATA[0]) for x in ([1], {}, None, "s")] + [page("{broken", DATA[0]), page({"videoDetails": GOOD}, "{broken"), "", None]


def test_same_as_python(spark):
    got = {r["id"]: r.asDict(recursive=True) for r in variants.video_records(spark.createDataFrame(list(enumerate(PAGES)), "id long, html string"), "id").collect()}
    want = {i: w for i, p in enumerate(PAGES) if (w := video.extract(p or "", "v")) and w["type"] == "video"}
    assert set(got) == set(want) and len(want) == len(ODD) + len(DATA) + 1
    for i, w in want.items():
        assert {f: got[i][f] for f in FIELDS} == {f: w[f] for f in FIELDS}, (i, ODD[i] if i < len(ODD) else None)
        for f in ("comments", "related", "chapters"):
            assert got[i][f] == w[f], (i, f)


def test_under_finds_all_depths(spark):
    d = spark.createDataFrame([(1, json.dumps(NEST)), (2, "[]"), (3, "not json"), (4, None)], "id long, j string").selectExpr("id", "try_parse_json(j) as v")
    rows = variants.under(d, "id", "v", ("chapterRenderer",)).collect()
    assert len(rows) == 30 and {len(r["at"]) for r in rows} == set(range(2, 62, 2)) and {r["id"] for r in rows} == {1}
