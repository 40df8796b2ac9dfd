"""Token alignment, periodic runs and chat windows on small fixtures, against plain definitions, with nulls, empty
and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment, chat, periodic
from graphloom.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, key long, batch long, code long, k long, best long, n_words int, runs int"


def docs_of(spark, rows):
    """rows: (doc_id, text); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], DOCS)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def plain_tokens(aligner, text):
    """Ids and byte ranges of both tokenizers on the whole text; none where bytes differ."""
    from tokenizers import Tokenizer

    if not hasattr(aligner, "plain"):
        aligner.plain = Tokenizer.from_file(A)
        aligner.plain.encode_special_tokens = True
    full = (" " + text).encode()
    sides = []
    for ids, table in ((aligner.plain.encode(" " + text, add_special_tokens=False).ids, aligner.a_bytes), (aligner.b.encode(text), aligner.b_bytes)):
        if not text or b"".join(table[i] for i in ids) != full:
            return [], []
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table[i])))
            at += len(table[i])
        sides.append(side)
    return sides


def brute_alignment(a, b):
    """Groups as text, their number, and how often each pair of ids overlaps."""
    groups, low = [], 0
    for end in sorted({x[2] for x in a} & {x[2] for x in b}):
        groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in (a, b)))
        low = end
    return ";".join(groups), len(groups), Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)


ODD = [*"abcde  \n\t▁<>|é漢字。123'\"ſ \x1c\x85 😀ñ,.-_", "the ", "ing", "<|endoftext|>", "</s>", "<s>", "  ", "tion ", "<0x0A>", " \n", " 's"]
WORDY = [*"abcdefgh", " in", " ", "tion", "er ", " the ", "ück"]


def test_fragments_compose(aligner):
    """Any text, cut into any ranges and composed in any order, gives what the whole text gives."""
    rnd, several, open_ends = random.Random(4), 0, 0
    for t in range(900):
        text = "".join(rnd.choice(WORDY if t % 3 else ODD) for _ in range(rnd.randint(0, 60)))
        a, b = plain_tokens(aligner, text)
        groups, n, links = brute_alignment(a, b)
        got = aligner.align_all([text])[0]
        assert (got.n_a, got.n_b, got.n_groups, got.text[:-1].decode()) == (len(a), len(b), n, groups)
        assert dict(zip(got.codes.tolist(), got.times.tolist())) == {i << 32 | j: k for (i, j), k in links.items()}
        if not a:
            continue
        parts = [aligner.align_range(near, at, start, stop) for at, start, stop, near in alignment.ranges(text, rnd.choice([5, 9, 16]), 40)]
        several += len(parts) > 1
        open_ends += any(len(p.tail[0]) + len(p.tail[1]) for p in parts)
        while len(parts) > 1:
            k = rnd.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.compose(parts[k], parts[k + 1])]
        whole = alignment.whole(alignment.compose(alignment.Fragment(), parts[0]))
        assert (whole.n_a, whole.n_b, whole.n_groups, whole.text) == (got.n_a, got.n_b, got.n_groups, got.text)
        assert (whole.codes == got.codes).all() and (whole.times == got.times).all()
    assert several > 200 and open_ends > 50


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 100])
def test_align_tokens(spark, aligner, chunk):
    rnd = random.Random(7)
    prose = lambda n: "".join(rnd.choice(WORDY) for _ in range(n))
    rows = [(i, prose(rnd.randint(1, 200))) for i in range(30)]
    rows += [rows[3], rows[3], (100, None), (101, ""), (102, "a▁b"), (None, "the end"), (103, "x" * 4000), (104, prose(6000)), (105, "</s><|endoftext|> 漢字"), (106, prose(300) + "▁")]
    tokens = [plain_tokens(aligner, t or "") for _, t in rows]
    found = [brute_alignment(*t) if len(t[0]) < 3000 else quick_alignment(*t) for t in tokens]
    holders = Counter(pair for _, _, links in found for pair in links)
    most = {}
    for (i, _), n in holders.items():
        most[i] = max(most.get(i, 0), n)
    want = []
    for (doc_id, _), (a, b), (groups, n, links) in zip(rows, tokens, found):
        best = sum(k for (i, j), k in links.items() if holders[i, j] == most[i])
        want.append((-1 if doc_id is None else doc_id, len(a), len(b), n, sum(links.values()), best, sum(k * holders[p] for p, k in links.items()), sha(groups) if groups else "", groups))
    got = alignment.align_tokens(docs_of(spark, rows), A, B, groups=True, chunk=chunk, halo=40).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *list(r)[1:]) for r in got) == sorted(want)
    assert any(len(list(alignment.ranges(t or "", 100, 40))) > alignment.FAN for _, t in rows)
    if chunk == 100:
        assert alignment.align_tokens(docs_of(spark, []), A, B).count() == 0


def quick_alignment(a, b):
    """brute_alignment for long texts, in one walk along both sides."""
    links, groups, i, j, first = Counter(), [], 0, 0, (0, 0)
    while i < len(a) and j < len(b):
        links[a[i][0], b[j][0]] += 1
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append("|".join(",".join(str(t[0]) for t in side) for side in (a[first[0] : i], b[first[1] : j])))
            first = i, j
    return ";".join(groups), len(groups), links


def brute_runs(words, least_words=24, least_repeats=3):
    out = {}
    for q in range(1, len(words) // least_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_repeats * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (9, 3), (1, 2)])
def test_runs(least):
    rnd = random.Random(1)
    for _ in range(120):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            n, k = rnd.randint(0, 120), rnd.choice([1, 2, 3, 5, 50])
            w = [b"%d" % rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 2) if n else 0):
                a = rnd.randrange(n)
                p, b, was = 1 + (n - a) // rnd.randint(2, 9), rnd.randint(a, n), list(w)
                w = [was[a + (i - a) % p] if a <= i < b else x for i, x in enumerate(w)]
            docs.append(w)
        assert periodic.runs_of(docs, *least) == [brute_runs(w, *least) for w in docs]


def test_periodic_report(spark):
    """Documents with known cycles, the greatest exponent, and digests."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdé", k=3))
    rows = [(i, "\t ".join(word() for _ in range(rnd.randint(1, 150)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "a b " * 30), (503, "la " * 24), (504, "la " * 23), rows[5], rows[5], (505, " ".join(word() for _ in range(5000)) * 3), (506, "no break " * 30)]
    rows += [(507, "p q r " * 10 + "| " + "s t u " * 10)]  # equal exponents: the earlier run
    got = periodic.run_report(periodic.periodic_runs(periodic.with_cycles(docs_of(spark, rows)))).collect()
    want = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        runs = brute_runs(w) if len(w) < 5000 else periodic.runs_of([w])[0]
        out = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        text = b" ".join(x for i, x in enumerate(w) if i not in out)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_runs"] > 0 for r in got) > 6
    again = periodic.periodic_runs(docs_of(spark, rows[:3]))
    assert again.columns[:-1] == docs_of(spark, []).columns and periodic.periodic_runs(docs_of(spark, [])).count() == 0


CHAT = "conv_id long, turn long, role string, text string, tokens int, cell int, total int, large_id int"


def native_tokens(text):
    return len(re.findall(r"[^\W\d_]{1,6}|\d{1,3}|[^ \t\n\x0b\x0c\r\w]|_", text))


def brute_windows(rows, budget, history, retained):
    """Of each conversation: (first token, repeated turns, turns as (role, text, new), tokens) of its windows."""
    by, out, stride = {}, {}, budget - history - retained
    for conv, turn, role, text in rows:
        text = text or ""
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    for conv, turns in by.items():
        turns.sort()
        size = [native_tokens(t[4]) + chat.MARKS for t in turns]
        before = [sum(size[:i]) for i in range(len(turns))]
        spans, i = [], 0
        while i < len(turns):
            j = i
            while j < len(turns) and before[j] // stride == before[i] // stride:
                j += 1
            over = before[j - 1] + size[j - 1] > (before[i] // stride + 1) * stride and sum(size[i:j]) > stride
            spans += [(i, j - 1), (j - 1, j)] if j - i > 1 and over else [(i, j)]
            i = j
        system = turns[0][2] == "system" and size[0] <= retained
        for a, b in spans:
            kept = [0] if system and a else []
            room = min(history, max(0, budget - sum(size[k] for k in kept) - sum(size[a:b])))
            old = kept + [k for k in range(int(system), a) if before[k] >= before[a] - room]
            said = [(turns[k][2], turns[k][4], k in range(a, b)) for k in [*old, *range(a, b)]]
            out.setdefault(conv, []).append((before[a], len(old), said, sum(size[k] for k in old) + sum(size[a:b])))
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(2)
    bits = ["<", "[", "\\", "/", "s>", "|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", " ok ", "a", "\n", "é", "𝄞", "<|im_sep|>", "INST]"]
    odd = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
    rows = []
    for c in range(25):
        for t in range(rnd.choice([1, 2, 3, 8, 40, 120])):
            role = rnd.choice(["system", "user", "assistant", "assistant", None, "to<|im_sep|>ol"]) if t else rnd.choice(["system", "user"])
            rows.append((c, t if rnd.random() < 0.97 else None, role, rnd.choice([odd(), "word " * rnd.randint(0, 60), None, ""])))
        if c % 5 == 0:
            rows.append((c, 5, "assistant", "x " * 400))
    return rows + [rows[3], rows[3], (None, 1, "user", "hi"), (None, 2, "assistant", "yo"), (90, 1, "assistant", "long " * 20_000)]


@pytest.mark.parametrize("budget,history,retained,large", [(4096, 1024, 512, False), (120, 40, 30, False), (120, 40, 30, True), (60, 20, 10, True)])
def test_chat_windows(spark, talks, budget, history, retained, large, monkeypatch):
    if large:  # most conversations are then dealt out by ranges
        monkeypatch.setattr(chat, "TASK_TURNS", 20)
        monkeypatch.setattr(chat, "RANGE_TURNS", 40)
    rows = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in talks], CHAT)
    windows = chat.format_conversations(rows, budget, history, retained).persist()
    got = {}
    for w in windows.withColumn("read", chat.parse_turns(F.col("formatted"))).orderBy("first_token").collect():
        got.setdefault(w["conv_id"], []).append(w)
    want = brute_windows(talks, budget, history, retained)
    assert {c: len(w) for c, w in got.items()} == {c: len(w) for c, w in want.items()}
    told = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    for conv, expected in want.items():
        new = []
        for w, (first, n_old, said, tokens) in zip(got[conv], expected):
            assert (w["first_token"], w["n_repeated"], w["n_turns"], w["tokens"]) == (first, n_old, len(said), tokens)
            assert [tuple(t) for t in w["read"]] == [t[:2] for t in said]
            assert tokens <= budget or sum(t[2] for t in said) == 1
            body = w["formatted"]
            for mark in (chat.BEGIN, chat.MIDDLE, chat.END):
                assert body.count(mark) == len(said)
            assert not any(c in body for c in chat.CONTROLS[3:])
            spans = [body[s["start"] : s["start"] + s["length"]] for s in w["loss_spans"]]
            assert len(spans) == sum(r == "assistant" and n for r, _, n in said)
            new += [t[:2] for t in said if t[2]]
        loss = "".join(t for r, t in new if r == "assistant")
        chars = sum(len(w["formatted"]) for w in got[conv])
        assert tuple(told[conv]) == (conv, len(new), sha("".join(f"{r}\n{t}\n" for r, t in new)), len(loss), sha(loss), chars)
    windows.unpersist()


def test_chat_edges(spark):
    empty = spark.createDataFrame([], CHAT)
    assert chat.format_conversations(empty).count() == 0 and chat.digests(chat.format_conversations(empty)).count() == 0
    with pytest.raises(ValueError):
        chat.format_conversations(empty, 100, 60, 50)
    two = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(two, 40, 10, 10, tokens=lambda t: F.length(t).cast("long") * 8).orderBy("first_token").collect()
    assert [w["first_token"] for w in windows] == [0, 28] and windows[1]["n_repeated"] == 0
    texts = ["<|im_start|>", "<\\|im_start|>", "<\\\\</s>", "[INST][/INST]", "<<s>", "<<SYS>><</SYS>>", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)
