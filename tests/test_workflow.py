import json
import os
import random
from dataclasses import replace
from hashlib import sha256
from pathlib import Path

import pytest

from contextframe import (
    AiAugmentOptions,
    ContentMapOptions,
    ContentSource,
    FetchOptions,
    InvalidCache,
    InvalidConfiguration,
    MalformedState,
    ProcessContentOptions,
    ProcessStage,
    SanitizeOptions,
    Unsupported,
    process_content,
)
from contextframe import workflow
from contextframe.operators.contentmap import StubProvider
from contextframe.operators.inventory import order_violations
from contextframe.sources.local_files import _Reader, list_files
from contextframe.workflow import discover

def put(root: Path, name: str, text: str) -> Path:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def fetched(spark, source, destination, copy=False, resume=False, **more):
    options = ProcessContentOptions(destination, fetch=FetchOptions(copy_local_files=copy, **more), resume=resume)
    return process_content(spark, ContentSource.local_path(source), options)


def paths(spark, root, **options):
    return [r.relative_path for r in discover(spark, str(root), FetchOptions(**options)).collect()]


def test_single_file(spark, tmp_path):
    text = "pub fn answer() -> u32 { 42 }\n"
    file = put(tmp_path, "lib.rs", text)
    (row,) = discover(spark, str(file), FetchOptions()).collect()
    assert row.asDict() == {
        "source": str(file),
        "relative_path": "lib.rs",
        "local_path": str(file),
        "media_type": "text/rust",
        "content_hash": sha256(text.encode()).hexdigest(),
    }
    assert paths(spark, file, include=("*.md",)) == []


def test_order_and_exclusion(spark, tmp_path):
    for name in ("alpha.txt", "nested/beta.txt", "nested/skip.txt"):
        put(tmp_path, name, name)
    assert paths(spark, tmp_path, include=("**/*",), exclude=("nested/skip.txt",)) == ["alpha.txt", "nested/beta.txt"]
    assert paths(spark, tmp_path, include=("**/*", "!nested/skip.txt", "!")) == ["alpha.txt", "nested/beta.txt"]
    assert paths(spark, tmp_path, include=("!**/beta*",)) == ["alpha.txt", "nested/skip.txt"]
    assert paths(spark, tmp_path, include=("nested/*", "nested/be*")) == ["nested/beta.txt", "nested/skip.txt"]


def test_odd_names(spark, tmp_path):
    names = [".dot", ".hidden/a.md", "_under/x", "a b#%.txt", "k=v/é.md", "empty", "z/y/x/deep.TXT"]
    for name in names:
        put(tmp_path, name, "" if name == "empty" else name)
    put(tmp_path, "bad.bin", "")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "empty", tmp_path / "link.txt")
    os.symlink(tmp_path / "z", tmp_path / "zlink")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    assert paths(spark, tmp_path) == sorted([*names, "bad.bin"], key=str.encode)
    assert list_files(spark, str(tmp_path), ["z/y/**"]).count() == 1


def test_backslash_names_collide_and_first_stays(spark, tmp_path):
    put(tmp_path, "a\\b", "1")
    put(tmp_path, "a/b", "2")
    assert paths(spark, tmp_path) == ["a/b"]


def test_fetch_without_copy(spark, tmp_path):
    file = put(tmp_path, "guide.md", "# Guide\n")
    handle = fetched(spark, file, tmp_path / "out")
    receiver = handle.take_progress_rx()
    assert receiver is not None and handle.take_progress_rx() is None
    out = handle.wait_output(120)
    (item,) = out.completed_items
    assert (item.source, item.output_path, item.stage) == ("guide.md", str(file), ProcessStage.FETCH)
    assert not out.skipped_items and not out.failures and out.content_root == str(file) and out.content_map_path is None
    manifest = json.loads(Path(out.manifest_path).read_text())
    assert manifest["complete"] and manifest["version"] == 1 and len(manifest["items"]) == 1
    assert [e.kind for e in receiver] == ["StageStarted", "ItemCompleted", "StageCompleted"]
    snapshot = handle.query().snapshot()
    assert snapshot.current_stage is None and len(snapshot.completed) == 1 and len(snapshot.progress_history) == 3


def test_fetch_with_copy(spark, tmp_path):
    root = tmp_path / "source"
    put(root, "a.txt", "alpha\n")
    put(root, "nested/b.txt", "beta\n")
    out = fetched(spark, root, tmp_path / "out", copy=True).wait_output(120)
    assert [i.source for i in out.completed_items] == ["a.txt", "nested/b.txt"]
    assert [Path(i.output_path).read_text() for i in out.completed_items] == ["alpha\n", "beta\n"]
    assert all(Path(i.output_path).is_relative_to(out.content_root) for i in out.completed_items)
    assert len(json.loads(Path(out.manifest_path).read_text())["items"]) == 2


def test_resume(spark, tmp_path):
    file, out = put(tmp_path, "source.txt", "initial\n"), tmp_path / "out"
    first = fetched(spark, file, out, copy=True).wait_output(120)
    before = Path(first.manifest_path).read_bytes()
    second = fetched(spark, file, out, copy=True, resume=True).wait_output(120)
    assert (len(second.completed_items), len(second.skipped_items)) == (0, 1) and Path(first.manifest_path).read_bytes() == before
    Path(first.completed_items[0].output_path).unlink()
    third = fetched(spark, file, out, copy=True, resume=True).wait_output(120)
    assert (len(third.completed_items), len(third.skipped_items)) == (1, 0) and Path(third.completed_items[0].output_path).read_text() == "initial\n"
    file.write_text("changed\n")
    fourth = fetched(spark, file, out, copy=True, resume=True).wait_output(120)
    assert len(fourth.completed_items) == 1 and Path(first.manifest_path).read_bytes() != before
    other = fetched(spark, file, out, copy=True, resume=True, max_depth=1).wait_output(120)
    assert len(other.completed_items) == 1  # options are part of the verdict


def test_failed_copy_fails_its_item_only(spark, tmp_path):
    root, out = tmp_path / "source", tmp_path / "out"
    put(root, "a.txt", "1")
    put(root, "b/c.txt", "2")
    put(out, ".ctx/fetch/b", "a file where a folder must be")
    result = fetched(spark, root, out, copy=True).wait_output(120)
    assert [i.source for i in result.completed_items] == ["a.txt"] and [f.item.source for f in result.failures] == ["b/c.txt"]
    manifest = json.loads(Path(result.manifest_path).read_text())
    assert not manifest["complete"] and [i["artifact_path"] is None for i in manifest["items"]] == [False, True]


@pytest.mark.parametrize(
    "source, options, error",
    [
        (".", {}, InvalidConfiguration),
        (".", {"fetch": FetchOptions(), "max_concurrency": 0}, InvalidConfiguration),
        ("https://example.com", {"fetch": FetchOptions()}, InvalidConfiguration),
        ("https://example.com", {"fetch": FetchOptions(same_host_only=True)}, Unsupported),
        ("missing", {"fetch": FetchOptions()}, InvalidConfiguration),
        (".", {"fetch": FetchOptions(), "ai_augment": AiAugmentOptions(" ", "m")}, InvalidConfiguration),
        (".", {"fetch": FetchOptions(), "content_map": ContentMapOptions("p", "\t")}, InvalidConfiguration),
        (".", {"sanitize": SanitizeOptions()}, MalformedState),
        ("https://example.com", {"sanitize": SanitizeOptions()}, MalformedState),
    ],
)
def test_invalid_requests_touch_nothing(spark, tmp_path, source, options, error):
    where = ContentSource.website(source) if source.startswith("https") else ContentSource.local_path(tmp_path / source)
    with pytest.raises(error):
        process_content(spark, where, ProcessContentOptions(tmp_path / "out", **options))
    assert not (tmp_path / "out").exists()


def test_later_stages_are_unsupported_when_awaited(spark, tmp_path):
    file, out = put(tmp_path, "source.txt", "source\n"), tmp_path / "out"
    fetched(spark, file, out).wait_output(120)
    for stage in ({"ai_augment": AiAugmentOptions("p", "m")}, {"content_map": ContentMapOptions("p", "m")}):
        handle = process_content(spark, ContentSource.local_path(file), ProcessContentOptions(out, **stage))
        with pytest.raises(Unsupported):
            handle.wait_output(60)
        assert handle.query().snapshot().current_stage == ("ai_augment" if "ai_augment" in stage else "ai_content_map")
    with pytest.raises(InvalidConfiguration):
        process_content(spark, ContentSource.website("https://x"), ProcessContentOptions(out, sanitize=SanitizeOptions()))


def _set(**change):
    return lambda m: m.update(change)


def _item(**change):
    return lambda m: m["items"][0].update(change)


@pytest.mark.parametrize(
    "spoil, error",
    [
        (_set(version=2), MalformedState),
        (_set(complete=False), MalformedState),
        (_set(source=" "), MalformedState),
        (_set(artifact_root="/elsewhere"), MalformedState),
        (_item(local_path=""), MalformedState),
        (_item(relative_path="../a.txt"), MalformedState),
        (_item(relative_path="./a.txt"), MalformedState),
        (_item(artifact_path=None), MalformedState),
        (_item(artifact_path="/x/a.txt"), MalformedState),
        (_item(content_hash="0" * 64), InvalidCache),
        (lambda m: m["items"].reverse(), MalformedState),
        (lambda m: m.pop("items"), MalformedState),
    ],
)
def test_prior_manifest_rules(spark, tmp_path, spoil, error):
    root, out = tmp_path / "source", tmp_path / "out"
    put(root, "a.txt", "1")
    put(root, "b.txt", "2")
    path = Path(fetched(spark, root, out, copy=True).wait_output(120).manifest_path)
    manifest = json.loads(path.read_text())
    spoil(manifest)
    path.write_text(json.dumps(manifest))
    handle = process_content(spark, ContentSource.local_path(root), ProcessContentOptions(out, sanitize=SanitizeOptions()))
    with pytest.raises(error):
        handle.wait_output(60)


def test_prior_manifest_absent_or_artifact_missing(spark, tmp_path):
    root, out = tmp_path / "source", tmp_path / "out"
    put(root, "a.txt", "1")
    result = fetched(spark, root, out, copy=True).wait_output(120)
    options = ProcessContentOptions(out, sanitize=SanitizeOptions())
    Path(result.completed_items[0].output_path).unlink()
    with pytest.raises(InvalidCache):
        process_content(spark, ContentSource.local_path(root), options).wait_output(60)
    Path(result.manifest_path).unlink()
    with pytest.raises(InvalidCache):
        process_content(spark, ContentSource.local_path(root), options).wait_output(60)


def test_many_waves(spark, tmp_path, monkeypatch):
    """Items in several waves give the manifest, order and events of one."""
    root = tmp_path / "source"
    names = [f"{'abc'[k % 3]}/{'xy' if k % 2 else 'z'}/f{k:03}.txt" for k in range(60)] + ["ä.txt", "z"]
    for name in names:
        put(root, name, name)
    whole = fetched(spark, root, tmp_path / "one", copy=True).wait_output(120)
    monkeypatch.setattr(workflow, "WAVE_ITEMS", 7)
    handle = fetched(spark, root, tmp_path / "two", copy=True)
    parts = handle.wait_output(120)
    want = sorted(names, key=str.encode)
    assert [i.source for i in parts.completed_items] == want == [i.source for i in whole.completed_items]
    assert [e.source for e in handle.query().snapshot().completed] == want
    one, two = (Path(o.manifest_path).read_text() for o in (whole, parts))
    assert two == one.replace(str(tmp_path / "one"), str(tmp_path / "two"))
    assert one == json.dumps(json.loads(one), indent=2, ensure_ascii=False) + "\n"
    again = fetched(spark, root, tmp_path / "two", copy=True, resume=True).wait_output(120)
    assert len(again.skipped_items) == len(names) and sorted(p.name for p in (tmp_path / "two/.ctx").iterdir()) == ["fetch", "manifest.json"]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "source").mkdir()
    out = fetched(spark, tmp_path / "source", tmp_path / "out", copy=True).wait_output(120)
    assert not out.completed_items and json.loads(Path(out.manifest_path).read_text())["items"] == []
    assert not fetched(spark, tmp_path / "source", tmp_path / "out", copy=True, resume=True).wait_output(120).failures


def test_deep_folders_are_dealt_out(spark, tmp_path):
    for k in range(40):
        put(tmp_path, f"one/only/way/d{k}/e/f{k}.txt", "x")
    reader = _Reader(str(tmp_path), [], [])
    parts = reader.partitions()
    assert len(parts) > 40 and sum(1 for p in parts for _ in reader.read(p)) == 40
    assert len(_Reader(str(tmp_path), ["one/only/way/d7/**"], []).partitions()) < 10


def test_later_stages_with_a_provider(spark, tmp_path):
    root, out = tmp_path / "source", tmp_path / "out"
    put(root, "a/page.html", "<html><head><title>t</title><script>x</script></head><body><nav>menu</nav><h1>Title</h1><p>Some  <b>text</b></p></body></html>")
    put(root, "a/note.txt", "a note\n")
    put(root, "lib.rs", "pub struct Thing;\npub fn run() {}\n")
    put(root, "image.png", "png")
    (root / "bad.txt").write_bytes(b"\xff")
    options = ProcessContentOptions(out, fetch=FetchOptions(), sanitize=SanitizeOptions(True, True), ai_augment=AiAugmentOptions("p", "m"), content_map=ContentMapOptions("p", "m"))
    handle = process_content(spark, ContentSource.local_path(root), options, StubProvider())
    result = handle.wait_output(120)
    of = lambda items, stage: {i.source: i.output_path for i in items if i.stage == stage}
    clean = of(result.completed_items, ProcessStage.SANITIZE)
    assert Path(clean["a/page.html"]).read_text() == "# Title\n\nSome **text**" and Path(clean["a/note.txt"]).read_text() == "a note\n"
    assert set(of(result.skipped_items, ProcessStage.SANITIZE)) == {"bad.txt", "image.png"}
    augmented = of(result.completed_items, ProcessStage.AI_AUGMENT)
    assert Path(augmented["a/note.txt"]).read_text() == "file: a/note.txt\n\na note\n" and set(augmented) == set(clean)
    assert result.content_root == str(out / ".ctx/augment") and (root / "a/note.txt").read_text() == "a note\n"
    record = json.loads(Path(result.content_map_path).read_text())
    assert set(record["file_map"]) == {"a/note.txt", "a/page.html", "lib.rs"} and set(record["folder_map"]) == {"", "a"}
    assert record["file_map"]["lib.rs"]["public_types"] == ["Thing"] and record["file_map"]["lib.rs"]["public_functions"] == ["run"]
    assert record["folder_map"]["a"]["summary"] == "2 files"
    stages = [e.stage for e in handle.query().snapshot().progress_history if e.kind == "StageStarted"]
    assert stages == ["fetch", "sanitize", "ai_augment", "ai_content_map"]
    journal = out / ".ctx/content-map.jsonl"
    assert len(journal.read_text().splitlines()) == 3
    put(root, "a/note.txt", "another note\n")
    result = process_content(spark, ContentSource.local_path(root), options, StubProvider()).wait_output(120)
    assert set(of(result.skipped_items, ProcessStage.AI_CONTENT_MAP)) == {"a/page.html", "lib.rs"}
    fresh = replace(options, content_map=ContentMapOptions("p", "m", reuse_unchanged_records=False, retain_journal=False))
    result = process_content(spark, ContentSource.local_path(root), fresh, StubProvider()).wait_output(120)
    assert len(of(result.completed_items, ProcessStage.AI_CONTENT_MAP)) == 3 and not journal.exists()


def test_order_over_ranges(spark):
    """A group over many ranges is compared across their edges too."""
    rng = random.Random(1)
    rows = [("a" if k < 900 else "b", k, rng.randrange(4) + k * (k % 5 > 0)) for k in range(1000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = order_violations(spark.createDataFrame(rows, "g string, pos long, v long").repartition(9), ["g"], "pos", "v").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {g: sum(x[0] == y[0] == g and x[2] >= y[2] for x, y in zip(rows, rows[1:])) for g in "ab"}
    assert {r.g: (r.violations, r.n_items) for r in got} == {"a": (want["a"], 900), "b": (want["b"], 100)}
