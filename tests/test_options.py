from pathlib import Path

import pytest

from contextframe import AiAugmentOptions, ContentMapOptions, ContentSource, FetchOptions, InvalidConfiguration, LocalContentSource, ProcessContentOptions, SanitizeOptions, WebsiteContentSource
from contextframe.errors import InvalidHeaderName, InvalidHeaderValue
from contextframe.sources.web_request import WebRequest


def test_workflow_options_chain():
    fetch, clean, ai, cmap = FetchOptions().with_include(["*.md"]), SanitizeOptions(True), AiAugmentOptions("p", "m"), ContentMapOptions("p", "m")
    o = ProcessContentOptions("out").with_fetch(fetch).with_sanitize(clean).with_ai_augment(ai).with_content_map(cmap).with_resume(True).with_max_concurrency(3)
    assert (o.fetch, o.sanitize, o.ai_augment, o.content_map, o.resume, o.max_concurrency) == (fetch, clean, ai, cmap, True, 3)
    plain = ProcessContentOptions("out")
    assert plain.max_concurrency == 8 and not plain.resume and plain.fetch is None


def test_fetch_options_replace_and_append():
    o = FetchOptions().with_include(["a"]).append_include("b").append_includes(["c", "d"]).with_exclude(["x"]).append_exclude("y").append_excludes(["z"])
    assert (o.include, o.exclude) == (("a", "b", "c", "d"), ("x", "y", "z"))
    assert o.with_include(["n"]).include == ("n",)
    o = o.with_copy_local_files(True).with_same_host_only(True).with_max_depth(2).with_follow_links(True)
    assert (o.copy_local_files, o.same_host_only, o.max_depth, o.follow_links) == (True, True, 2, True)


def test_stage_options():
    s = SanitizeOptions().with_slim_html(True).with_convert_to_markdown(True)
    assert s.slim_html and s.convert_to_markdown
    assert AiAugmentOptions("p", "m").with_provider("q").with_model("n") == AiAugmentOptions("q", "n")
    c = ContentMapOptions("p", "m")
    assert c.journal_path is None and c.reuse_unchanged_records and c.retain_journal
    c = c.with_provider("q").with_model("n").with_journal_path("j").with_reuse_unchanged_records(False).with_retain_journal(False)
    assert c == ContentMapOptions("q", "n", "j", False, False)


def test_sources_are_typed():
    assert ContentSource.of(LocalContentSource("a")) == ContentSource.of(Path("a")) == ContentSource.local_path("a")
    assert ContentSource.of(WebsiteContentSource("https://x")).is_website
    with pytest.raises(InvalidConfiguration):
        ContentSource.of("a")


def test_web_request():
    r = WebRequest("https://x").append_header("A-b", "1").append_param("q", "2").append_params([("r", "3")])
    assert (r.headers, r.params) == ((("a-b", "1"),), (("q", "2"), ("r", "3")))
    with pytest.raises(InvalidHeaderName):
        r.append_header("a b", "1")
    with pytest.raises(InvalidHeaderValue):
        r.with_headers([("a", "x\ny")])
