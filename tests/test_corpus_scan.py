"""Files that are no html stay out of the page scan."""

import datetime as dt
import os

from quarry.sources import corpus


def test_page_scan_sees_html_files_only(spark, monkeypatch):
    seen = []
    real = corpus.html_main_text

    def spy(html):
        seen.append(html)
        return real(html)

    monkeypatch.setattr(corpus, "html_main_text", spy)
    rows = [("/r/a.html", b"<p>one &amp; two</p>"), ("/r/b.txt", b"<p>kept as it is</p>"), ("/r/c.md", b"x\xff<y>")]
    files = spark.createDataFrame([(p, dt.datetime(2024, 1, 1), len(c), c) for p, c in rows], "path string, modificationTime timestamp, length long, content binary")
    got = {r.path: r.text for r in corpus.decode_files(files, "/r").collect()}
    assert got == {"a.html": "one & two", "b.txt": "<p>kept as it is</p>", "c.md": "x<y>"}
    given = files.select("path", seen[0].alias("given")).collect()
    assert {r.path for r in given if r.given is not None} == {"/r/a.html"}


def test_listing_takes_few_tasks_and_leaves_the_session_alone(spark, tmp_dir):
    for i in range(40):
        os.makedirs(f"{tmp_dir}/part={i}")
        with open(f"{tmp_dir}/part={i}/a.txt", "w") as f:
            f.write(f"text {i}")
    before = spark.conf.get(corpus.LISTING)
    sc = spark.sparkContext
    sc.setJobGroup("listing-of-test", "")
    files = corpus.scan_corpus(spark, tmp_dir)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing-of-test") for s in tracker.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [tracker.getStageInfo(s).numTasks for s in stages] == [corpus.LISTING_WAVES * sc.defaultParallelism]
    assert spark.conf.get(corpus.LISTING) == before
    assert files.count() == 40
