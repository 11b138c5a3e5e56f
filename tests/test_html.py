from contextframe.operators import html
from contextframe.operators.contentmap import StubProvider, file_map, folder_map, reuse_journal
from contextframe.functions.paths import glob_regex
import re


def test_markdown():
    page = '<head><title>t</title></head><h2>A &amp; B</h2><p>x <b>y</b> <a href="/u">z</a><script>no</script><ul><li>1<li>2</ul>'
    assert html.markdown_of(page) == "## A & B\n\nx **y** [z](/u)\n\n- 1\n\n- 2"
    assert html.markdown_of(None) == ""


def test_globs():
    cases = {
        "**/*": (["a", "a/b"], []),
        "*.md": (["x.md"], ["a/x.md", "xmd"]),
        "a/**/z": (["a/z", "a/b/c/z"], ["b/z"]),
        "a/**": (["a/b/c"], ["b/a/c"]),
        "[!a]?.{rs,md}": (["bc.rs", "xx.md"], ["ab.rs", "bc.txt"]),
        "f+(1).txt": (["f+(1).txt"], ["f1.txt"]),
    }
    for glob, (yes, no) in cases.items():
        assert all(re.search(glob_regex(glob), p) for p in yes) and not any(re.search(glob_regex(glob), p) for p in no), glob


def test_crawl_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.url: r.depth for r in html.crawl(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_content_map_and_journal(spark):
    items = spark.createDataFrame([("d/a.rs", "pub fn go() {} struct Thing;", "h1"), ("d/b.txt", "alpha beta gamma", "h2"), ("e.txt", None, "h3")], "relative_path string, text string, content_hash string")
    files = file_map(items, StubProvider())
    by = {r.path: r for r in files.collect()}
    assert by["d/a.rs"].public_functions == ["go"] and by["d/a.rs"].public_types == ["Thing"] and by["e.txt"].topics == []
    folders = {r.path: r for r in folder_map(files).collect()}
    assert set(folders) == {"d", ""} and folders["d"].summary == "2 files"
    journal = spark.createDataFrame([("d/a.rs", "h1", "c1", "s"), ("d/b.txt", "old", "c1", "s"), ("e.txt", "h3", "c2", "s")], "relative_path string, content_hash string, configuration string, summary string")
    reused, pending = reuse_journal(items, journal, "c1")
    assert [r.relative_path for r in reused.collect()] == ["d/a.rs"] and sorted(r.relative_path for r in pending.collect()) == ["d/b.txt", "e.txt"]
