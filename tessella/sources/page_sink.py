"""Pages as a data source to write to: tasks write files aside, a commit moves them into place, all checks first.

``df.write.format("pages").option("root", folder).option("job", name).save()`` takes rows of ``target_path``, ``markdown`` and ``preimage_sha256``
(null: the page must not exist). A task compares each page with what was seen of it, writes the new one below
``.pages/<job>`` and reports hashes, never contents. The commit looks at every page's stamp once more before it moves any;
the list of moves is written before the first, so a commit that stops in between is carried on by ``recover``. Whatever fails earlier
leaves all pages as they were.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "target_path string, markdown string, preimage_sha256 string"
ASIDE = ".pages"


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    local = re.match(r"^file:/*(/.*)$", root)
    where = local[1] if local else root
    return (fs.LocalFileSystem(), where.rstrip("/")) if where.startswith("/") else fs.FileSystem.from_uri(where.rstrip("/"))


def _stamp(store: fs.FileSystem, path: str) -> list | None:
    info = store.get_file_info(path)
    return None if info.type == fs.FileType.NotFound else [info.size, info.mtime_ns]


def _move(store: fs.FileSystem, page: dict, folder: str) -> None:
    """Into place in one step; nothing to do where that has been done."""
    if store.get_file_info(page["aside"]).type == fs.FileType.NotFound:
        return
    final = f"{folder}/{page['target_path']}"
    store.create_dir(posixpath.dirname(final), recursive=True)
    store.move(page["aside"], final)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote aside: target, file, hashes before and after, and the stamp of the page that it is to replace."""

    pages: list[dict]


class PageWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Written:
        store, folder = filesystem(self.root)
        context, out = TaskContext.get(), []
        aside = f"{folder}/{ASIDE}/{self.job}"
        store.create_dir(aside, recursive=True)
        for n, row in enumerate(iterator):
            parts = row.target_path.split("/")
            if row.target_path.startswith("/") or ".." in parts or "" in parts:
                raise ValueError(f"not a path of a page: {row.target_path}")
            final = f"{folder}/{row.target_path}"
            stamp, before = _stamp(store, final), None
            if stamp is not None:
                with store.open_input_stream(final) as seen:
                    before = hashlib.sha256(seen.read()).hexdigest()
            if before != row.preimage_sha256:
                raise ValueError(f"pages changed since they were read: {row.target_path}")
            data = row.markdown.encode()
            name = f"{aside}/{context.partitionId()}-{context.taskAttemptId()}-{n}"
            with store.open_output_stream(name) as file:
                file.write(data)
            out.append({"target_path": row.target_path, "aside": name, "before": before, "after": hashlib.sha256(data).hexdigest(), "stamp": stamp})
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.root)
        pages = [p for m in messages if m is not None for p in m.pages]
        names = [p["target_path"] for p in pages]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"pages written twice: {', '.join(sorted({n for n in names if names.count(n) > 1})[:5])}")
        late = [p["target_path"] for p in pages if _stamp(store, f"{folder}/{p['target_path']}") != p["stamp"]]
        if late:
            self.abort(messages)
            raise ValueError(f"pages changed since they were read: {', '.join(late[:5])}")
        if pages:
            journal = f"{folder}/{ASIDE}/{self.job}.json"
            with store.open_output_stream(f"{journal}.tmp") as file:
                file.write(json.dumps({"job": self.job, "pages": pages}, ensure_ascii=False).encode())
            store.move(f"{journal}.tmp", journal)
            finish(store, folder, self.job, pages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = filesystem(self.root)
        store.delete_dir_contents(f"{folder}/{ASIDE}/{self.job}", missing_dir_ok=True)


def finish(store: fs.FileSystem, folder: str, job: str, pages: list[dict]) -> None:
    """Make the moves of a journal and put the journal among the finished ones, as the record of hashes before and after."""
    for page in pages:
        _move(store, page, folder)
    store.create_dir(f"{folder}/{ASIDE}/done", recursive=True)
    store.move(f"{folder}/{ASIDE}/{job}.json", f"{folder}/{ASIDE}/done/{job}.json")
    if store.get_file_info(f"{folder}/{ASIDE}/{job}").type != fs.FileType.NotFound:
        store.delete_dir(f"{folder}/{ASIDE}/{job}")


def recover(root: str, stale: float = 86_400.0) -> list[str]:
    """Carry on the commits that stopped between their first move and their last; their jobs. Files set aside by writes that failed
    ``stale`` seconds ago or more go: a task may end, and leave some, after its job has been given up."""
    store, folder = filesystem(root)
    found = store.get_file_info(fs.FileSelector(f"{folder}/{ASIDE}", allow_not_found=True))
    jobs = []
    for info in found:
        if info.type == fs.FileType.File and info.path.endswith(".json"):
            with store.open_input_stream(info.path) as file:
                made = json.loads(file.read())
            finish(store, folder, made["job"], made["pages"])
            jobs.append(made["job"])
    for info in found:
        if info.type == fs.FileType.Directory and info.base_name not in ("done", *jobs) and time.time() - info.mtime_ns / 1e9 >= stale:
            store.delete_dir(info.path)
    return sorted(jobs)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["root"], self.options["job"])
