"""The paged search as a data source: offsets, restarts, failures, caps."""

import json

import pytest

from trendloom.sources import connectors, landing, paged


def _record(folder, query, ids):
    (folder / f"query={query}").mkdir(parents=True, exist_ok=True)
    rows = [{"id": str(i), "text": f"post {i}", "author_id": "7", "created_at": f"2026-01-0{1 + i // 100}T00:00:00Z"} for i in ids]
    (folder / f"query={query}" / f"{min(ids):09}.json").write_text("\n".join(map(json.dumps, rows)))


class Flaky(paged.RecordedPosts):
    """Fails for good while a file named down lies in the folder, and each first request of a process once."""

    failed = False

    def page(self, params):
        if (self.folder / "down").exists() and params["query"] == "b" and params["max_results"] != "10":
            raise connectors.CallFailed("permanent")
        if not Flaky.failed:
            Flaky.failed = True
            raise connectors.CallFailed("transient", 0.01)
        return super().page(params)


def flaky(options):
    return Flaky(options["folder"])


def test_streams_go_on_from_the_last_completed_run(spark, tmp_path):
    spark.dataSource.register(paged.PagedSearch)
    folder, out = tmp_path / "posts", str(tmp_path / "out")
    options = {"queries": json.dumps({"a": "a", "b": "b"}), "folder": str(folder), "transport": "tests.test_paged:flaky", "now": "2026-01-08T00:00:00", "page_size": 20, "max_pages": 99, "max_posts": 9999}

    def run():
        q = spark.readStream.format("paged_search").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    def ids():
        pages = spark.read.parquet(out)
        return sorted((r.page.split("/")[0], int(r.x_tweet_id)) for r in landing.map_posts(landing.pages_of(pages)).select("page", "x_tweet_id").collect())

    _record(folder, "a", range(60, 130))
    _record(folder, "b", range(1, 8))
    run()
    first = [*[("a", i) for i in range(100, 130)], *[]]  # the first run takes the window of seven days, not what is older
    assert ids() == sorted([*[("a", i) for i in range(60, 130) if i >= 100], *[("b", i) for i in range(1, 8) if i >= 100]]) == first
    run()
    assert ids() == first  # nothing new
    _record(folder, "a", range(130, 175))
    _record(folder, "b", [205, 206])
    (folder / "down").touch()
    with pytest.raises(Exception, match="permanent|CallFailed"):
        run()
    assert ids() == first  # a failed run advances nothing
    (folder / "down").unlink()
    run()
    assert ids() == sorted([*first, *[("a", i) for i in range(130, 175)], ("b", 205), ("b", 206)])
    stops = {(r.query, r.stop) for r in spark.read.parquet(out).where("stop is not null").collect()}
    assert stops == {("a", "exhausted"), ("b", "exhausted")}


def test_batch_reads_and_caps(spark, tmp_path):
    spark.dataSource.register(paged.PagedSearch)
    _record(tmp_path, "a", range(1, 101))
    read = lambda **more: spark.read.format("paged_search").options(**{"queries": '{"a": "a"}', "folder": str(tmp_path), "now": "2026-01-03T00:00:00", "page_size": 10, "max_posts": 100, "max_pages": 99} | more).load().orderBy("page").collect()
    assert [r.stop for r in read(max_pages=3)] == [None, None, "page_cap"] and [r.stop for r in read(max_posts=20)] == [None, "post_cap"]
    rows = read(cursors='{"a": "75"}')
    assert [len(json.loads(r.body)["data"]) for r in rows] == [10, 10, 5] and rows[-1].stop == "exhausted"
    assert [p["id"] for r in rows for p in json.loads(r.body)["data"]] == [str(i) for i in range(100, 75, -1)]
    assert len(read(cursors='{"a": "100"}')) == 1  # an empty page


def test_runs_in_parts_read_each_folder_once(spark, tmp_path, monkeypatch):
    """600 posts in spans of 100 ids: as many lines are parsed for a page's folders as they hold, and
    parts give every post once, in pages with numbers of their own."""
    for first in range(0, 600, 100):
        (tmp_path / "query=a" / f"span={first}").mkdir(parents=True)
        rows = [{"id": str(i), "text": f"post {i}", "author_id": "7", "created_at": "2026-01-01T00:00:00Z"} for i in range(first, first + 100)]
        (tmp_path / "query=a" / f"span={first}" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    options = {"queries": '{"a": "a"}', "folder": str(tmp_path), "now": "2026-01-02T00:00:00", "page_size": "10", "max_pages": "99", "max_posts": "9999", "ids_per_task": "100"}
    search = paged._Search(options)
    parsed, loads = [0], json.loads
    monkeypatch.setattr(paged.json, "loads", lambda line: parsed.__setitem__(0, parsed[0] + 1) or loads(line))
    assert search.newest("a", None) == "599" and parsed[0] <= 110
    for since, until in ((None, "599"), ("249", "555"), ("399", "400")):
        spans = search.spans({"a": since} if since else {}, {"a": until})
        parsed[0] = 0
        rows = [(p, page) for p, span in enumerate(spans) for page in search.pages(span)]
        assert parsed[0] <= 100 * len(spans) + int(until) - int(since or -1)  # each line once, and once more in its page
        assert [p["id"] for _, r in rows for p in loads(r[3])["data"]] == [str(i) for i in range(int(until), int(since or -1), -1)]
        numbers = [r[1] for _, r in rows]
        assert numbers == sorted(set(numbers)) and [r[2] for _, r in rows].count("exhausted") == len(spans)
    whole = [r for s in paged._Search(options | {"ids_per_task": "0"}).spans({}, {"a": "599"}) for r in search.pages(s)]
    assert [p["id"] for r in whole for p in loads(r[3])["data"]] == [str(i) for i in range(599, -1, -1)] and [r[1] for r in whole] == list(range(1, 61))
