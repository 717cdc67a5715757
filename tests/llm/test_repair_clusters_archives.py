"""Conversation repair, centroid clustering and archives against brute force, on small fixtures with every odd case."""

import hashlib
import io
import itertools
import math
import random
import zlib
from base64 import b32encode
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import centroids, dialogue, warc
from cohortry.llm.queries import QUERIES
from cohortry.llm.seekable import SeekableReader

SF = "/root/testdata/sf0.001"

# 11


def slow_clusters(rows, k=16, rounds=3, seed=1):
    """All distances, in Python's integers; rows: (id, components)."""
    kept = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, c, d in found:
        sums[c] += d
    most = 2**63 - 1
    return sorted(((i, c, min(d, most), min(sums[c], most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def run_clusters(spark, rows, monkeypatch, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({"x": F.lit(1), "h": F.lit("z"), "cluster": F.lit("c"), "c": F.lit(2)})
    from types import SimpleNamespace

    fake = SimpleNamespace(read=SimpleNamespace(parquet=lambda _: df), createDataFrame=spark.createDataFrame)
    return sorted((tuple(r) for r in centroids.op11_bisector_kmeans(fake, "").collect()), key=str)


def test_clusters_with_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(60)]
    rows += [(7, rows[7][1]), (100, rows[7][1]), (None, rows[8][1]), (101, None), (102, []), (103, [1.0] * 63), (104, [1.0] * 63 + [None]), (105, [math.inf] * 64), (106, [math.nan] * 64), (107, [0.0] * 64)]
    assert run_clusters(spark, rows, monkeypatch) == slow_clusters(rows)
    assert run_clusters(spark, [], monkeypatch) == []
    assert run_clusters(spark, rows[:5], monkeypatch) == slow_clusters(rows[:5])


def test_clusters_of_ties_and_of_huge_numbers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    ties = [(i, [float(x) / 64 for x in rng.integers(0, 2, 3)] + [0.0] * 61) for i in range(80)]
    assert run_clusters(spark, ties, monkeypatch) == slow_clusters(ties)
    huge = [(i, [float(x) for x in rng.normal(size=64) * 10.0 ** rng.integers(0, 30)]) for i in range(30)] + [(31, [1e308] * 64), (32, [-1e308] * 64)]
    assert run_clusters(spark, huge, monkeypatch, "double") == slow_clusters(huge)


def test_tournament_equals_all_distances():
    rng = np.random.default_rng(2)
    cents = rng.integers(-3, 4, (9, 4)).tolist() + [[0, 0, 0, 0]] * 2
    x = rng.integers(-4, 5, (5000, 4))
    best, distance = centroids.Bisectors.of(cents).assign(x)
    all_ = ((x[:, None] - np.array(cents)[None]) ** 2).sum(axis=2)
    assert (best == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


# 12


def slow_repair(rows):
    """One conversation by a plain automaton and whole audits; rows: (turn, role, text) in order."""
    roles = {"u": "user", "a": "assistant"}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen, blank, dup, cut, faults = set(), 0, 0, 0, []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        blank, dup, cut = blank + (fault == "blank"), dup + (fault == "dup"), cut + (fault == "cut")

    def inserted(best):
        for _ in range(2):
            for q, (c, a, out) in list(best.items()):
                for t in "ua":
                    if (q, t) in moves:
                        new = (c + 5, a + "I", [*out, f"{roles[t]}:"])
                        best[moves[q, t]] = min(best.get(moves[q, t], new), new)
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def put(q, way, after=after):
            after[q] = min(after.get(q, way), way)

        for q, (c, a, out) in inserted(dict(best)).items():
            put(q, (c + 2, a + "D", out))
            if fault in ("", "cut"):
                extra = 5 * (fault == "cut")
                if (q, role[:1]) in moves:
                    put(moves[q, role[:1]], (c + extra, a + "K", [*out, f"{role}:{text}"]))
                for t in "ua":
                    if (q, t) in moves:
                        put(moves[q, t], (c + 1 + extra, a + "R", [*out, f"{roles[t]}:{text}"]))
        best = after
    c, a, out = min(v for q, v in inserted(best).items() if q in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return gaps, blank, dup, cut, illegal, c, a, hashlib.sha256("\n".join(out).encode()).hexdigest()


def all_ways(rows, most=2):
    """The least (cost, audit) over every edit sequence, by enumeration."""
    import re

    best = None
    options = []
    for k in range(len(rows) + 1):
        gap = [(5 * n, "I" * n, "".join(t)) for n in range(most + 1) for t in itertools.product("ua", repeat=n)]
        if k == len(rows):
            options.append(gap)
            continue
        _, role, text = rows[k]
        body, again = text.strip(), rows[k][1:] in [r[1:] for r in rows[:k]]
        own = [(2, "D", "")]
        if body and not again:
            extra = 5 * (body[-1] not in ".!?")
            own += [(extra, "K", role[:1]), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options.append([(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a in gap for b in own])
    for way in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            found = (sum(w[0] for w in way), "".join(w[1] for w in way))
            best = found if best is None or found < best else best
    return best


def damage(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 1:
        text = ""
    if kind == 2:
        text = text.translate({ord(c): None for c in ".!?"})
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def slow_conversations(rows, hurt=True):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv] += damage(conv, turn, role, text) if hurt else [(turn, " " if role is None else role, " " if text is None else text)]
    return {conv: slow_repair(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, g in groups.items()}


def run_repair(spark, rows, n=8):
    from types import SimpleNamespace

    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"conv": F.lit(1), "n": F.lit("n"), "part": F.lit(2), "a.b": F.lit(3), "copies": F.lit(0)}).repartition(n)
    got = dialogue.op12_lr_repair(SimpleNamespace(read=SimpleNamespace(parquet=lambda _: df)), "").collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def random_conversation(rng, n):
    texts = ["Yes.", "No!", "why", "", " \n", "So?", "cut off,", "x. \t", "y\x85", None]
    roles = ["user", "assistant", "system", "", "tool", "unknown", None]
    return [(rng.choice([None, *range(max(1, n))]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.") for _ in range(n)]


def test_search_equals_every_way():
    rng, s = random.Random(3), dialogue.Stacks()
    for _ in range(60):
        rows = [(t, r or " ", x or " ") for t, r, x in random_conversation(rng, rng.randint(0, 3))]
        got = slow_repair(rows)
        assert got[5:7] == all_ways(rows)
        run, seen = dialogue.Run("x"), set()
        for t, r, x in rows:
            run.add(t, r, x, 1, (r, x) in seen)
            seen.add((r, x))
        tops, back = s.search(run.items)
        cost, node = dialogue._best_end(tops)
        letters, messages = run.repaired(back, node, s.tail(node))
        lines = "\n".join(f"{m[0]}:{m[1]}" for step in messages for m in step)
        assert (cost, "".join(letters), hashlib.sha256(lines.encode()).hexdigest()) == got[5:]


def test_stacks_of_the_grammar():
    s = dialogue.Stacks()
    reach = lambda word: {n for n in word_stacks(s, word) if s.accepts(n)}
    for word, good in (("", True), ("sua", True), ("uaua", True), ("suaua", True), ("s", False), ("u", False), ("au", False), ("suasua", False), ("uas", False)):
        assert bool(reach(word)) == good
    with pytest.raises(ValueError, match="left-recursive"):
        dialogue.Stacks((("C", "u"), ("C", "uC")))


def word_stacks(s, word):
    now = {0}
    for t in word:
        now = {m for n in now for m in s.push(n, t)}
    return now


def test_repair_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(c, *r) for c in range(120) for r in random_conversation(rng, rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none."), (500, None, None, None), (501, 3, "user", "long " * 50_000 + "."), (501, 4, "assistant", "ok.")]
    rows += [(502, 1, "user", "same."), (502, 1, "user", "same."), (502, 1, "user", "same.")]
    assert run_repair(spark, rows) == slow_conversations(rows)
    assert run_repair(spark, []) == {}


@pytest.mark.parametrize("few", [0, dialogue.FEW])
def test_repair_of_hot_conversation(spark, monkeypatch, few):
    """One conversation that every range has a piece of, and one of equal rows alone."""
    monkeypatch.setattr(dialogue, "FEW", few)  # repeats are joined by salts, or broadcast
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"t{i}.", f"u{i}"])) for i in range(3000)]
    rows += [(2, 1, "user", "x.")] * 500 + [(3, None, "assistant", f"n{i}.") for i in range(300)] + [(4, 1, "user", "q."), (4, 2, "assistant", "r.")]
    assert run_repair(spark, rows) == slow_conversations(rows)


def test_repaired_messages(spark):
    df = spark.createDataFrame([("k", 1, "assistant", "Hello."), ("k", 2, "user", "Hm?"), ("k", 3, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    reports, chunks = dialogue.repair(df)
    assert reports.select("conv", "cost", "audit").collect() == [("=k", 2, "DKK")]
    assert [tuple(m)[:3] for c in chunks.orderBy("part", "chunk").collect() for m in c.messages] == [("user", "Hm?", "K"), ("assistant", "Yes.", "K")]


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_lr_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == slow_conversations(rows) and len(got) == len({r[0] for r in rows})


# 13

PAGES = "page_id bigint, url string, html string"


def slow_pages(rows, least=0):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = best[html or ""]
        response = len(data) < least or last == (-1 if page is None else page)
        out.append((page, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response or last < 0 else last))
    return sorted(out, key=str)


def test_archives_with_odd_rows(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>page {i // 3}\r\n\r\nWARC/1.1\r\n</p>") for i in range(30)] + [(40, None, None), (41, "http://x y\r\nZ: é", ""), (42, "", "é漢\U0001f600" * 400_000), (None, "n", "alone")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"_row": F.lit("z"), "target": F.lit(1), "_digest": F.lit(2), "file": F.lit(3)})
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for least in (0, 25):
        index = warc.write_bundles(df, min_bytes=least)
        assert sorted((tuple(r) for r in warc.read_bundles(index).select(*columns).collect()), key=str) == slow_pages(rows, least)
    index = warc.write_bundles(df)
    ids = {r.page_id: r.record_id for r in index.collect()}
    got = {r.record_id: bytes(r.payload) for r in warc.resolve(index, spark.createDataFrame([(x,) for x in ids.values()], "record_id string")).collect()}
    assert got == {ids[p]: (h or "").encode() for p, _, h in rows}
    empty = warc.write_bundles(df.filter("page_id < 0"))
    assert empty.count() == 0 and warc.read_bundles(empty).count() == 0


def test_archives_of_repeated_rows(spark):
    rows = [(7, "u", "same")] * 40 + [(3, "u", "same"), (None, "v", "same"), (None, None, "none"), (None, None, "none")]
    got = warc.read_bundles(warc.write_bundles(spark.createDataFrame(rows, PAGES))).toPandas()
    same = got[got.payload_digest == b32encode(hashlib.sha1(b"same").digest()).decode()]
    assert len(got) == 44 and (same.record_type == "response").sum() == 1 and same[same.record_type == "response"].page_id.tolist() == [7]
    assert set(same[same.record_type == "revisit"].refers_to) == {7} and (got.record_type == "response").sum() == 2
    assert set(same[same.record_type == "revisit"].refers_to_record) == set(same[same.record_type == "response"].record_id)


def test_archive_files_and_index(spark, monkeypatch):
    """Any zstandard tool reads a whole file; the index finds each record; a damaged frame is an error."""
    import zstandard

    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(400)], PAGES).coalesce(1)
    index = warc.write_bundles(df, frame_bytes=2000, file_bytes=8000).collect()
    assert len({r.file for r in index}) > 1 and max(r.frame for r in index) > 3
    for file in {r.file for r in index}:
        reader = SeekableReader(file)
        data = open(file.removeprefix("file:"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = [reader.content(k) for k in range(len(reader.table))]
        assert plain == b"".join(frames)
        at, found = 0, []
        while at < len(plain):
            fields, _, at = warc.parse_record(plain, at)
            found.append(fields[b"warc-record-id"].decode())
        assert sorted(found) == sorted(r.record_id for r in index if r.file == file)
        for r in (r for r in index if r.file == file):
            record = frames[r.frame][r.offset : r.offset + r.length]
            assert warc.parse_record(record)[0][b"warc-record-id"].decode() == r.record_id
        bad = bytearray(data)
        bad[reader.table[0][0] // 2] ^= 255
        monkeypatch.setattr(reader, "file", type("F", (), {"read_at": lambda self, n, at, bad=bytes(bad): bad[at : at + n]})())
        with pytest.raises(Exception):  # noqa: B017, PT011
            reader.content(0)
    with pytest.raises(ValueError, match="no whole record"):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
