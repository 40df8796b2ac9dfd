"""A provider's stored trees and blobs against a plain walk, with listings cut off at any level and bad responses."""

import base64
import hashlib
import json
import os
import random

import pytest

from graphloom.sources import provider as P


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


class Store:
    """Random trees as responses in a folder, and their entries by a plain walk."""

    def __init__(self, folder, seed, cut):
        self.folder, self.rnd, self.cut, self.n = str(folder), random.Random(seed), cut, 0
        self.root, self.entries = self.tree(0)

    def put(self, name, value):
        path = f"{self.folder}/{name}.json"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            json.dump(value, f)

    def tree(self, depth):
        self.n += 1
        name, own, all_ = sha(f"tree{self.n}"), [], []
        for i in range(self.rnd.randint(1, 5)):
            if depth < 4 and self.rnd.random() < 0.6:
                child, below = self.tree(depth + 1)
                own.append({"path": f"d{i}", "mode": "040000", "type": "tree", "sha": child})
                all_ += [own[-1], *({**e, "path": f"d{i}/{e['path']}"} for e in below)]
            else:
                mode, type_ = self.rnd.choice([("100644", "blob"), ("120000", "blob"), ("160000", "commit")])
                own.append({"path": f"f{i}", "mode": mode, "type": type_, "sha": sha(f"{self.n}/{i}"), "size": i})
                all_.append(own[-1])
        self.put(f"trees/{name}", {"sha": name, "tree": own, "truncated": False})
        truncated = self.rnd.random() < self.cut or (depth == 0 and self.cut > 0)
        self.put(f"recursive/{name}", {"sha": name, "tree": all_[: len(all_) // 2] if truncated else all_, "truncated": truncated})
        return name, all_


@pytest.mark.parametrize("seed,cut,parts", [(1, 0.0, 4), (2, 0.5, 3), (3, 1.0, 3), (4, 1.0, 10_000), (5, 0.7, 1)])
def test_tree_equals_walk(spark, tmp_path, seed, cut, parts):
    store = Store(tmp_path, seed, cut)
    got = P.provider_tree(spark, store.folder, store.root, partitions=parts).collect()
    kinds = {"120000": "symlink", "160000": "submodule", "040000": "tree"}
    want = [(e["path"], e["mode"], e["type"], kinds.get(e["mode"], "blob"), e["sha"], e.get("size")) for e in store.entries]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert P.is_truncated(store.folder, store.root) == (cut > 0)


def test_traversal_limit(spark, tmp_path):
    store = Store(tmp_path, 3, 1.0)
    trees = sum(e["type"] == "tree" for e in store.entries)
    assert P.provider_tree(spark, store.folder, store.root, limit=trees).count() == len(store.entries)
    with pytest.raises(P.ProviderError, match="traversal_limit"):
        P.provider_tree(spark, store.folder, store.root, limit=trees - 1)
    whole = Store(tmp_path / "whole", 3, 0.0)  # a listing that wasn't cut off has no limit
    assert P.provider_tree(spark, whole.folder, whole.root, limit=1).count() == len(whole.entries)


@pytest.mark.parametrize(
    "entry",
    [
        {"path": "../x", "mode": "100644", "type": "blob", "sha": sha("a")},
        {"path": "a//b", "mode": "100644", "type": "blob", "sha": sha("a")},
        {"path": "a\\b", "mode": "100644", "type": "blob", "sha": sha("a")},
        {"path": "", "mode": "100644", "type": "blob", "sha": sha("a")},
        {"path": "a", "mode": "100644", "type": "blob", "sha": "A" * 40},
        {"path": "a", "mode": "100644", "type": "tag", "sha": sha("a")},
        {"path": "a", "mode": "100644", "type": "commit", "sha": sha("a")},
    ],
)
def test_bad_entries(tmp_path, entry):
    store = Store(tmp_path, 1, 0.0)
    store.put(f"trees/{sha('bad')}", {"tree": [entry]})
    with pytest.raises(P.ProviderError, match="invalid_response"):
        P.Responses(store.folder).tree(sha("bad"), False)


def test_bad_responses(tmp_path):
    store = Store(tmp_path, 1, 0.0)
    responses = P.Responses(store.folder)
    with pytest.raises(P.ProviderError, match="not_found"):
        responses.tree(sha("none"), True)
    with pytest.raises(P.ProviderError, match="invalid_response"):
        responses.tree("main", True)
    store.put(f"trees/{sha('list')}", [1])
    store.put(f"trees/{sha('no tree')}", {"tree": None})
    for name in ("list", "no tree"):
        with pytest.raises(P.ProviderError, match="invalid_response"):
            responses.tree(sha(name), False)


def test_blobs(spark, tmp_path):
    store = Store(tmp_path, 1, 0.0)
    text = "é\n" * 30
    raw = text.encode()
    coded = base64.b64encode(raw).decode()
    forms = {
        "plain": ({"encoding": "base64", "content": coded, "size": len(raw)}, None),
        "lines": ({"encoding": "base64", "content": "\n".join(coded[i : i + 60] for i in range(0, len(coded), 60)) + "\n", "size": len(raw)}, None),
        "text": ({"encoding": "utf-8", "content": text, "size": len(raw)}, None),
        "empty": ({"encoding": "base64", "content": "", "size": 0}, None),
        "size": ({"encoding": "base64", "content": coded, "size": len(raw) + 1}, "provider-identity-mismatch"),
        "sha": ({"encoding": "base64", "content": coded, "size": len(raw), "sha": sha("x")}, "provider-identity-mismatch"),
        "encoding": ({"encoding": "latin-1", "content": text, "size": len(raw)}, "invalid-response"),
        "negative": ({"encoding": "base64", "content": coded, "size": -1}, "invalid-response"),
        "true": ({"encoding": "base64", "content": coded, "size": True}, "invalid-response"),
        "none": ({"encoding": "base64", "content": None, "size": 0}, "invalid-response"),
        "broken": ({"encoding": "base64", "content": "*" + coded, "size": len(raw)}, "binary-or-invalid-utf8"),
    }
    for name, (body, _) in forms.items():
        store.put(f"blobs/{sha(name)}", {"sha": sha(name), **body})
    rows = [(sha(n), 1) for n in [*forms, "plain", "missing"]] + [("main", 2), (None, 3)]
    got = {r["sha"]: r for r in P.provider_blobs(spark.createDataFrame(rows, "sha string, size int"), store.folder).collect()}
    assert len(got) == len(forms) + 2
    assert got[sha("missing")]["reason"] == "missing" and got["main"]["reason"] == "invalid-response"
    for name, (body, reason) in forms.items():
        r = got[sha(name)]
        assert r["reason"] == reason and (r["content"] is None) == (reason is not None)
        if reason is None:
            assert bytes(r["content"]) == (b"" if name == "empty" else raw) and r["size"] == len(r["content"])
