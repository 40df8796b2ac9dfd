"""A provider's stored responses as Spark data sources: whole trees from listings that may be cut off, and blobs.

The folder of a repository holds each response as the provider gave it: `trees/SHA.json` lists one level,
`recursive/SHA.json` everything below, unless its `truncated` says that it was cut off; `blobs/SHA.json` is one
file's content.  A tree that was cut off is taken apart: its subtrees become partitions of the scan, which executors
list on their own, going down further where a listing of theirs was cut off too."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: subtrees that are listed for one tree at most.
TRAVERSAL_LIMIT = 10_000
#: Partitions that a scan is cut into, about, before executors go on.
PARTITIONS = 64
SHA = re.compile(r"[0-9a-f]{40}\Z")
ENTRY = "path string, mode string, type string, kind string, sha string, size long"


class ProviderError(ValueError):
    """A response that can't be used, by its code."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")


def checked_sha(sha) -> str:
    if not isinstance(sha, str) or not SHA.match(sha):
        raise ProviderError("invalid_response", f"not an object's name: {sha!r}")
    return sha


def checked_path(path) -> str:
    parts = path.split("/") if isinstance(path, str) else [""]
    if "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in parts):
        raise ProviderError("invalid_response", f"not a path: {path!r}")
    return path


def kind_of(mode: str, type_: str) -> str:
    if (mode, type_) == ("120000", "blob"):
        return "symlink"
    if (mode, type_) == ("160000", "commit"):
        return "submodule"
    if type_ in ("blob", "tree"):
        return type_
    raise ProviderError("invalid_response", f"an entry of mode {mode} and type {type_}")


class Responses:
    """Stored responses in any folder that pyarrow can open: local, shared or in an object store."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))

    def get(self, name: str) -> dict:
        try:
            with self.files.open_input_stream(f"{self.folder}/{name}.json") as f:
                value = json.loads(f.read())
        except FileNotFoundError:
            raise ProviderError("not_found", name) from None
        except ValueError:
            raise ProviderError("invalid_response", name) from None
        if not isinstance(value, dict):
            raise ProviderError("invalid_response", name)
        return value

    def tree(self, sha: str, recursive: bool) -> tuple[list[tuple], bool]:
        """Entries (path, mode, type, kind, sha, size) of a listing, and whether it was cut off."""
        value = self.get(f"{'recursive' if recursive else 'trees'}/{checked_sha(sha)}")
        if not isinstance(value.get("tree"), list):
            raise ProviderError("invalid_response", f"no tree in {sha}")
        out = []
        for e in value["tree"]:
            kind = kind_of(e.get("mode"), e.get("type"))
            out.append((checked_path(e.get("path", "")), e["mode"], e["type"], kind, checked_sha(e.get("sha")), e.get("size")))
        return out, value.get("truncated") is True


@dataclass
class Subtrees(InputPartition):
    """Trees (sha, prefix) that a task lists; own: entries that are known already, from planning the scan."""

    trees: tuple = ()
    own: tuple = ()


def below(entries: list[tuple], prefix: str) -> list[tuple]:
    return [(checked_path(f"{prefix}/{e[0]}") if prefix else e[0], *e[1:]) for e in entries]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.sha = options["path"], options["tree"]
        self.limit = int(options.get("traversallimit", TRAVERSAL_LIMIT))
        self.parts = int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Subtrees]:
        """One for a tree whose listing is whole.  Otherwise trees are listed level by level until there are enough of
        them to deal out, and what was met on the way is a partition of its own."""
        responses = Responses(self.folder)
        if not responses.tree(self.sha, True)[1]:
            return [Subtrees(((self.sha, ""),))]
        met: list[tuple] = []
        open_ = [(self.sha, "")]
        while open_ and len(open_) < self.parts:
            following = []
            for sha, prefix in open_:
                entries = below(responses.tree(sha, False)[0], prefix)
                met += entries
                following += [(e[4], e[0]) for e in entries if e[3] == "tree"]
            open_ = following
        share = -(-len(open_) // self.parts) or 1
        return [Subtrees(own=tuple(met)), *(Subtrees(tuple(open_[i : i + share])) for i in range(0, len(open_), share))]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        yield from partition.own
        responses, open_, listed = Responses(self.folder), list(partition.trees), 0
        while open_:
            sha, prefix = open_.pop()
            entries, cut = responses.tree(sha, True)
            if cut:
                entries = responses.tree(sha, False)[0]
            entries = below(entries, prefix)
            yield from entries
            trees = [(e[4], e[0]) for e in entries if e[3] == "tree"]
            listed += len(trees)
            if prefix and listed > self.limit:
                raise ProviderError("traversal_limit", f"more than {self.limit} subtrees")
            open_ += trees if cut else []


class ProviderTree(DataSource):
    """spark.read.format("provider_tree").option("tree", SHA).load(folder): every entry below a tree."""

    @classmethod
    def name(cls) -> str:
        return "provider_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def is_truncated(folder: str, sha: str) -> bool:
    """Whether a tree's own listing was cut off."""
    return Responses(folder).tree(sha, True)[1]


def provider_tree(spark: SparkSession, folder: str, sha: str, limit: int = TRAVERSAL_LIMIT, partitions: int = PARTITIONS) -> DataFrame:
    """path, mode, type, kind, sha, size of everything below a tree.

    A listing that was cut off is completed from its subtrees' listings; more subtrees than `limit` are an error
    (traversal_limit), as are names, paths, modes and types that no tree has (invalid_response) and responses that
    aren't there (not_found).  A whole listing is taken as it is, whatever its size."""
    spark.dataSource.register(ProviderTree)
    read = spark.read.format("provider_tree").option("tree", sha).option("traversalLimit", limit).option("partitions", partitions)
    entries = read.load(folder)
    if is_truncated(folder, sha) and entries.filter("kind = 'tree'").count() > limit:
        raise ProviderError("traversal_limit", f"more than {limit} subtrees")
    return entries


def blob_of(value: dict, sha: str) -> tuple[bytes | None, str | None]:
    """Content of a blob's response, or the reason why there is none."""
    encoding, text, size = value.get("encoding"), value.get("content"), value.get("size")
    if encoding not in ("base64", "utf-8") or not isinstance(text, str) or isinstance(size, bool) or not isinstance(size, int) or size < 0:
        return None, "invalid-response"
    if value.get("sha") != sha:
        return None, "provider-identity-mismatch"
    try:
        content = base64.b64decode(re.sub(r"[ \t\r\n]", "", text), validate=True) if encoding == "base64" else text.encode()
    except (binascii.Error, ValueError):
        return None, "binary-or-invalid-utf8"
    return (content, None) if len(content) == size else (None, "provider-identity-mismatch")


def provider_blobs(entries: DataFrame, folder: str) -> DataFrame:
    """sha, content, size, reason for each distinct sha of entries(sha, ...): blobs are fetched by their names, each
    once, by the task that holds it.  reason is null where the content came; what isn't there is `missing`."""

    def fetch(batches):
        import pyarrow as pa

        responses = Responses(folder)
        shape = pa.schema([("sha", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("reason", pa.string())])
        for batch in batches:
            for sha in batch.column("sha").to_pylist():
                try:
                    content, reason = blob_of(responses.get(f"blobs/{checked_sha(sha)}"), sha)
                except ProviderError as e:
                    content, reason = None, "missing" if str(e).startswith("not_found") else "invalid-response"
                row = (sha, content, None if content is None else len(content), reason)
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, shape)], schema=shape)

    return entries.select("sha").filter(F.col("sha").isNotNull()).distinct().mapInArrow(fetch, "sha string, content binary, size long, reason string")


def store_responses(responses: DataFrame, folder: str) -> None:
    """Write responses(name, body) as the files of a provider's folder, `name` being such as trees/SHA."""

    def write(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                path = f"{base}/{name}.json"
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(path) as f:
                    f.write(body.encode())
        yield from ()

    responses.select("name", "body").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
