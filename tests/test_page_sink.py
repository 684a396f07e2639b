"""Pages written by tasks: what stays, what is refused, commits that stop in between."""

import hashlib
import json

import pytest

from tessella.sources import page_sink, vault

NEW = "target_path string, markdown string"
OLD = "target_path string, preimage_sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def root(tmp_path):
    for i in range(6):
        path = tmp_path / "wiki" / "concepts" / f"P{i}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"old {i}")
    return tmp_path


def wiki(root):
    return {str(p.relative_to(root / "wiki")): p.read_text() for p in (root / "wiki").rglob("*.md")}


def test_pages_are_written_by_tasks(spark, root, monkeypatch):
    new = spark.createDataFrame([(f"concepts/P{i}.md", f"new {i} 页") for i in range(8)], NEW).repartition(4)
    seen = spark.createDataFrame([(f"concepts/P{i}.md", sha(f"old {i}") if i < 6 else None) for i in range(8)], OLD)
    monkeypatch.setattr(type(new), "toLocalIterator", None)
    out = {r.target_path: r.content_sha256 for r in vault.write_pages(spark, str(root), new, seen).collect()}
    assert wiki(root) == {f"concepts/P{i}.md": f"new {i} 页" for i in range(8)} and out == {k: sha(v) for k, v in wiki(root).items()}
    (record,) = (root / "wiki" / ".pages" / "done").iterdir()
    pages = {p["target_path"]: (p["before"], p["after"]) for p in json.loads(record.read_text())["pages"]}
    assert pages == {f"concepts/P{i}.md": (sha(f"old {i}") if i < 6 else None, sha(f"new {i} 页")) for i in range(8)}
    assert [p.name for p in (root / "wiki" / ".pages").iterdir()] == ["done"]
    vault.write_pages(spark, str(root), new.limit(0), seen)
    assert {r.path for r in vault.text_files(spark, f"{root}/wiki", "*.md").collect()} == set(wiki(root))


def save(spark, root, rows):
    spark.dataSource.register(page_sink.Pages)
    df = spark.createDataFrame(rows, page_sink.SCHEMA).repartition(3)
    df.write.format("pages").mode("append").option("root", f"{root}/wiki").option("job", "j1").save()


@pytest.mark.parametrize("bad", [("concepts/P1.md", "late", sha("another")), ("concepts/P1.md", "late", None), ("concepts/P9.md", "late", sha("gone")), ("../escape.md", "x", None), ("a//b.md", "x", None)])
def test_what_was_not_seen_stops_everything(spark, root, bad):
    before = wiki(root)
    with pytest.raises(Exception, match="changed since they were read|not a path"):
        save(spark, root, [(f"concepts/N{i}.md", "new", None) for i in range(5)] + [bad])
    assert wiki(root) == before and not (root / "escape.md").exists()
    page_sink.recover(f"{root}/wiki", stale=0)
    assert wiki(root) == before and not list((root / "wiki" / ".pages").glob("j1/*"))


def test_a_page_twice_is_refused(spark, root):
    before = wiki(root)
    with pytest.raises(Exception, match="written twice"):
        save(spark, root, [("concepts/N.md", "a", None), ("concepts/N.md", "b", None)])
    assert wiki(root) == before


def test_a_page_that_changes_before_the_commit_stops_it(root):
    store, folder = page_sink.filesystem(f"file:{root}/wiki")
    aside = root / "wiki" / ".pages" / "j2"
    aside.mkdir(parents=True)
    pages = []
    for i in range(3):
        (aside / str(i)).write_text(f"new {i}")
        pages.append({"target_path": f"concepts/P{i}.md", "aside": f"{aside}/{i}", "before": sha(f"old {i}"), "after": sha(f"new {i}"), "stamp": page_sink._stamp(store, f"{folder}/concepts/P{i}.md")})
    (root / "wiki" / "concepts" / "P2.md").write_text("someone else's longer text")
    before = wiki(root)
    with pytest.raises(ValueError, match="changed since"):
        page_sink.PageWriter(f"{root}/wiki", "j2").commit([page_sink.Written(pages), None])
    assert wiki(root) == before


def test_a_commit_that_stops_in_between_is_carried_on(root, monkeypatch):
    store, folder = page_sink.filesystem(f"{root}/wiki")
    aside = root / "wiki" / ".pages" / "j3"
    aside.mkdir(parents=True)
    pages = []
    for i in range(5):
        (aside / str(i)).write_text(f"new {i}")
        pages.append({"target_path": f"new/N{i}.md", "aside": f"{aside}/{i}", "before": None, "after": sha(f"new {i}"), "stamp": None})
    move, moved = page_sink._move, []

    def dies(*args):
        if len(moved) == 2:
            raise KeyboardInterrupt
        moved.append(args)
        move(*args)

    monkeypatch.setattr(page_sink, "_move", dies)
    with pytest.raises(KeyboardInterrupt):
        page_sink.PageWriter(f"{root}/wiki", "j3").commit([page_sink.Written(pages)])
    monkeypatch.undo()
    assert sum(k.startswith("new/") for k in wiki(root)) == 2
    assert page_sink.recover(f"{root}/wiki") == ["j3"] and page_sink.recover(f"{root}/wiki") == []
    assert {k: v for k, v in wiki(root).items() if k.startswith("new/")} == {f"new/N{i}.md": f"new {i}" for i in range(5)}
