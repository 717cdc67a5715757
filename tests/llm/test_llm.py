"""The corpus operators against brute force, on small fixtures with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup, graph, line_dedup, minhash, mixing, packing, pii, quality_rules, simhash, token_counts, token_files, weighted_sampling
from cohortry.llm.common import keyed
from cohortry.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(12_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "The  quick\tbrown\nfox jumps over the lazy dog.", "en", "a", 44),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, "Été à la plage, naïve çà et là.\nДругой язык 漢字 \U0001f600", "fr", "c", 50),
    (None, "no id", "en", "a", 5),
    (8, "same row", "en", "a", 8),
    (8, "same row", "en", "a", 8),
    (10, "a b <|endoftext|> c<|startoftext|>d\n<|endoftext|>\n<|EndOfText|> <|endoftext|>", "en", "a", 60),
    (9, "odd\x1cspaces\x85and\xa0others  here​", "en", "a", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"_salt": F.lit(1), "digest": F.lit("x"), "_n": F.lit("y"), "file": F.lit(0), "kept": F.lit(2), "_row": F.lit("z"), "_stats": F.lit(3), "a.b": F.lit(4)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


# 1


def test_line_dedup(spark):
    rows = [(i, f"http://H.example/{i}", f"<p>menu</p><p>own {i}</p><div>rare {i // 5}</div>") for i in range(10)]
    rows += [(10, "http://small.example/", "<p>menu</p>"), (11, None, "x<br>x"), (12, "http://h.example/n", None), (12, "http://h.example/n", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(df, max_ratio=5 / 12).collect()}
    assert got[3].text == "own 3\nrare 0" and (got[3].n_lines, got[3].n_dropped) == (3, 1)  # a ratio equal to the limit stays
    assert got[10].text == "menu" and got[11].text == "x\nx" and got[11].host is None and got[12].n_lines == 0
    assert line_dedup.drop_boilerplate(df.filter("page_id < 0")).collect() == []
    # The ratio alone decides: a line of one page of six is over a tenth, and clashing columns are ignored.
    six = spark.createDataFrame([(i, f"http://h/{i}", f"<p>own {i}</p><p>all</p>") for i in range(6)], "page_id int, url string, html string").withColumns({c: F.lit("x") for c in ("lines", "drop", "digest", "_host", "_salt", "pages", "n")})
    assert {r.text for r in line_dedup.drop_boilerplate(six, max_ratio=0.1).collect()} == {""} and {r.text for r in line_dedup.drop_boilerplate(six, max_ratio=0.2).collect()} == {f"own {i}" for i in range(6)}
    lone = six.filter("page_id = 0")
    assert line_dedup.drop_boilerplate(lone, min_pages=1).first().text == "" and line_dedup.drop_boilerplate(lone).first().text == "own 0\nall"


def lines_of(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(line_dedup.text_lines(F.col("html")).alias("x")).first().x


@pytest.mark.parametrize("html, want", [
    ("a<!-- b<p>c", ["a"]), ("a<script>x</script><p>b<script>y", ["a", "b"]), ("a<style>x", ["a"]), ("a<!-- x -->b", ["ab"]),
    ("a -- b --&gt; c -->", ["a -- b --&gt; c -->"]), ("a < b <p", ["a < b <p"]), ("<p>a</p>b <c", ["a", "b <c"]), ("1 < 2<br>3 > 2", ["1  2"]), (None, []), ("<p> \t</p>", ["\t"]),
])
def test_broken_markup(spark, html, want):
    assert lines_of(spark, html) == want


def test_long_broken_pages_take_linear_time(spark):
    import time

    began = time.perf_counter()
    for part in ("<!-- ", "<script ", "<", "<p ", "<style>"):
        lines_of(spark, part * 200_000)
    assert lines_of(spark, "<p>x</p>\n" * 50_000) == ["x"] * 50_000
    rows = [(i, "http://h/", "".join(f"<p>{j}</p>" for j in range(20_000))) for i in range(5)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert all((r.n_lines, r.n_dropped, r.text) == (20_000, 20_000, "") for r in got)
    assert time.perf_counter() - began < 60


# 2


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    mail = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
    ip = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    card = re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
    phone = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    return [
        [m.span() for m in mail],
        [m.span() for m in ip if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in card if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)],
        [m.span() for m in phone if 8 <= len(digits(m[0])) <= 15],
    ]


def test_base_spans():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1@@..-+%0257 ()4111111111111111é") for _ in range(rng.randrange(45)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("9" * 200_000) and pii.base_spans("a" * 100_000 + "@")  # long runs take linear time


def test_pii_adds_what_labelers_support(spark, odd, empty):
    rows = [(i, f"please call me at 415-555-{1000 + i} tomorrow or jane{i} (at) mail (dot) com ok") for i in range(30)]
    rows += [(i, f"write mail to a{i}@b.com or call +1 (415) 555-{1000 + i} now") for i in range(30, 90)]
    rows += [(i, f"part 7{i % 10}3-555-{1000 + i}x") for i in range(90, 120)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [s.kind for s in found[3]] == [0, 3] and not any(s.base for s in found[3])
    assert [s.kind for s in found[40]] == [0, 3] and all(s.base for s in found[40])
    assert found[100] == []
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(empty).count() == 0


@pytest.mark.parametrize("kind, span", [
    (0, "jane [at] example.com"), (0, "jane at example.com"), (0, "jane (AT) mail.example.org"), (0, "jane [ at ] mail [ dot ] com"),
    (1, "2001:db8::1"), (1, "fe80::1ff:fe23:4567:890a"), (1, "::1"), (1, "2001:db8:0:0:0:0:2:1"),
    (3, "415-555-1234"), (3, "01 23 45 67 89"), (3, "030 1234567"), (3, "(0171) 234 56 78"), (3, "612 345 678"), (3, "91 234 56 78"), (3, "(11) 4321-1234"), (3, "020 7946 0958"),
])
def test_looser_candidates_in_any_text(kind, span):
    for before, after in (("reach ", " now"), ("an anecdote: ", " ok"), ("", "")):
        text = before + span + after
        got = [text[s:e] for s, e in pii.looser_spans(text, pii.base_spans(text))[kind]]
        assert len(got) == 1 and span in got[0], (text, got)


def test_looser_candidates_need_their_shape():
    for text in ("std::vector<int> x1", "at 12:30:45 or 1::2::3", "a:b:c:d:e:f:1:2:3", "in 1999 2000 2001", "we met at noon. Then 5 left", "12345::1"):
        assert not any(pii.looser_spans(text, pii.base_spans(text))), text
    for text in ("0" * 200_000 + ":" * 100_000 + "1 at " * 20_000, "a" * 200_000 + "@", "mail." * 40_000 + "@", "@" + "a." * 100_000, "tel 1 " * 40_000, "x" * 70_000 + " at y.z"):
        pii.find(text)  # linear
    text = "x" * 70_000 + " at y.z"
    assert [(k, s, e) for k, s, e, *_ in pii.find(text)] == [(0, 0, len(text))]  # however long the name is


PLANTED = {  # spans that no strict pattern has, by kind, and what looks like them
    0: (["jane{i} (at) mail.example.com", "jane{i} [at] mail [dot] com", "jane{i} @ example . org"], ["meet at noon {i}", "a{i} @ b"]),
    1: (["2001:db8::{i}", "fe80::1ff:fe23:4567:{i}"], ["std::vector{i}", "12:30:{i}"]),
    2: (["card 4{i:03d}.1111.1111.1111", "visa: 5{i:03d}/2222/3333/4444"], ["6{i:03d}0000111122229", "{i}1234567890123456"]),
    3: (["call 415-555-1{i:03d}", "tel (0171) 234 5{i:03d}", "+49 (30) 555-1{i:03d} 10.0.0.1"], ["version 1{i:03d}-55", "order 9{i:03d}"]),
}


def planted():
    rng, rows, want = random.Random(12), [], set()
    strict = ["a{i}@b.com", "10.0.{j}.7", "4111111111111111", "+1 (415) 555-1{i:03d}"]
    for i in range(400):
        kind = i % 4
        yes, no = PLANTED[kind]
        span = rng.choice(yes).format(i=i % 250)
        rows += [f"xy {span} zz", f"xy {rng.choice(no).format(i=i % 250)} zz", f"xy {strict[kind].format(i=i % 250, j=i % 250)} zz", f"some words and {i} more"]
        want.add((len(rows) - 4, kind))
    return rows, want


@pytest.mark.parametrize("move", ["least 0.5", "least 0.75", "prior / 2", "prior x 2", "flat guess"])
def test_hand_set_numbers_may_move(move, monkeypatch):
    """Planted spans are found, and what looks like them isn't added, with each of the numbers chosen by hand moved."""
    rows, want = planted()
    least = float(move.split()[1]) if move.startswith("least") else pii.LEAST
    if move.startswith("prior"):
        monkeypatch.setattr(pii, "PRIOR", pii.PRIOR * (0.5 if "/" in move else 2.0))
    if move == "flat guess":
        monkeypatch.setattr(pii, "first_guess", lambda c: min(0.9, max(0.1, 0.5 + 0.1 * sum("-0+".index(x) - 1 for x in c[1 : pii.VOTERS + 1]))))
    found = [pii.find(t) for t in rows]
    cells = Counter(c[4] for f in found for c in f)
    names, counts = sorted(cells), np.array([cells[c] for c in sorted(cells)], float)
    p, table = pii.reliabilities(names, counts)
    scores = dict(zip(names, pii.classifier(names, p, counts), strict=True))
    got = {(d, k) for d, f in enumerate(found) for k, _, _, base, cell in f if not base and cell[1] != "+" and scores[cell] >= least}
    assert min(np.mean([w in got for w in want if w[1] == k]) for k in range(4)) >= 0.9
    assert (table[:, 1, 0, 2] > table[:, 0, 0, 2]).all()  # the strict pattern is estimated, and right more often than not


def test_recall_of_planted_spans(spark):
    rows, want = planted()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {(r.doc_id, s.kind) for r in pii.personal_data(df).collect() for s in r.spans if not s.base}
    recall = {k: np.mean([w in got for w in want if w[1] == k]) for k in range(4)}
    assert min(recall.values()) >= 0.9, recall
    assert len(got - want) <= 0.05 * len(want), sorted(got - want)[:20]


def slow_votes(items, rounds=50):
    """EM over single candidates with plain loops: the probability of each."""
    p = [pii.first_guess(c) for c in items]
    for _ in range(rounds):
        like = {}
        for kind in range(4):
            own = [(c, x) for c, x in zip(items, p, strict=True) if int(c[0]) == kind]
            for y in (0, 1):
                for j in range(pii.VOTERS):
                    strength = 1 if j else 1 + len(own) / 21  # the strict pattern's prior counts as much as all that are seen
                    n = {v: pii.PRIOR[y, j, "-0+".index(v)] * strength for v in "-+"}
                    for c, x in own:
                        if c[1 + j] != "0":
                            n[c[1 + j]] += x if y else 1 - x
                    like[kind, y, j] = {v: n[v] / sum(n.values()) for v in n}
            like[kind] = (sum(x for _, x in own) + 1) / (len(own) + 2)
        new = []
        for c in items:
            k = int(c[0])
            odds = like[k] / (1 - like[k])
            for j in range(pii.VOTERS):
                if c[1 + j] != "0":
                    odds *= like[k, 1, j][c[1 + j]] / like[k, 0, j][c[1 + j]]
            new.append(odds / (1 + odds))
        p = new
    return p


def test_em_equals_plain_loops():
    rows, _ = planted()
    items = [c[4] for t in rows[:600] for c in pii.find(t)]
    want = dict(zip(items, slow_votes(items), strict=True))
    cells = sorted(set(items))
    p, _ = pii.reliabilities(cells, np.array([items.count(c) for c in cells], float))
    assert [want[c] for c in cells] == pytest.approx(p.tolist(), abs=1e-6)
    scores = pii.classifier(cells, p, np.array([items.count(c) for c in cells], float))
    sure = (p < 0.05) | (p > 0.95)
    assert ((scores > 0.5) == (p > 0.5))[sure].mean() > 0.9


# 3, 4 and their tokenizer


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_word_memo_equals_library(name):
    enc, lib, rng = Encoder(tokenizer_path(name), remembered=50), library(name), random.Random(1)
    pieces = ["the", "The", "don't", " ", "  ", "\n", "\t", "é", "É", "é", "漢", "!!", ",", "...", "1", "42", "\x1c", "\x85", "\xa0", "<|endoftext|>", "İ", "ß", "ª", "​", "AB***", "$$$", "'s", "x's"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randrange(14)))
        assert enc.encode(t) == lib(t).tobytes(), repr(t)


def test_token_files_round_trip(odd, empty, sample):
    for docs in (odd, sample):
        lib = library(WORD_BPE)
        want = Counter((r.doc_id, tuple(lib(r.text).tolist()) + (1,)) for r in docs.collect())
        index = token_files.write_token_files(docs).cache()
        got = token_files.with_starts(token_files.read_token_files(index)).orderBy("start").collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert ids == sorted(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    some = token_files.read_token_files(index.filter("doc_id IN (5, 77)")).collect()
    assert sorted(r.doc_id for r in some) == [5, 77]
    assert token_files.write_token_files(empty).count() == 0


def test_token_file_format_and_damage(spark, sample, tmp_path):
    import zstandard

    index = token_files.write_token_files(sample, f"file://{tmp_path}/t")
    file = index.orderBy("file").first().file.removeprefix("file://")
    data = open(file, "rb").read()
    reader = token_files.FrameReader(f"file://{file}")
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # any zstandard tool reads it
    assert len(plain) == sum(size for _, size, _ in reader.table)
    bad = bytearray(data)
    bad[reader.table[0][0] // 2] ^= 255
    open(file, "wb").write(bad)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(f"file://{file}").frame(0)


def check_packing(pieces, placed, capacity):
    assert placed.groupby("sequence_id").length.sum().max() <= capacity
    for _, g in placed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist()
    assert sorted(zip(pieces._row, pieces.piece, strict=True)) == sorted(zip(placed._row, placed.piece, strict=True))


def test_packing(odd, empty, sample):
    lib = library(BYTE_BPE)
    for docs in (odd, sample):
        pieces, placed, cert = packing.pack_documents(docs)
        pieces, placed = pieces.toPandas(), placed.toPandas()
        check_packing(pieces, placed, 2048)
        assert cert["bound"] <= cert["bins"][-1] == placed.sequence_id.nunique()
        by_row = pieces.sort_values("piece").groupby("_row")
        got = Counter((None if p.doc_id.isna().all() else int(p.doc_id.iloc[0]), b"".join(p.ids)) for _, p in by_row)
        assert got == Counter((r.doc_id, lib(r.text).tobytes() + b"\0\0\0\0") for r in docs.collect())
        for _, p in by_row:
            assert (p.length.iloc[1:] == 2048).all() and p.start.tolist() == np.cumsum([0, *p.length])[:-1].tolist()
    pieces, placed, cert = packing.pack_documents(empty)
    assert placed.count() == 0 and packing.digest(pieces, placed, cert).count() == 0


def test_exchange_between_partitions(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.randint(1, 100)) for i in range(4000)]
    pieces = spark.createDataFrame(rows, "_row bigint, piece int, length bigint").cache()
    placed, cert = packing.pack(pieces, 100, per_part=100, fan_in=4, given_bins=20)
    check_packing(pieces.toPandas(), placed.toPandas(), 100)
    assert cert["bins"] == sorted(cert["bins"], reverse=True) and cert["bins"][-1] < cert["bins"][0]
    assert cert["bound"] <= placed.select("sequence_id").distinct().count() == cert["bins"][-1]
    # One partition goes on in two groups where best-fit decreasing misses the bound.
    rows = [(i, 0, n) for i, n in enumerate([44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3)]  # 540 of 60 a bin
    pieces = spark.createDataFrame(rows, "_row bigint, piece int, length bigint").cache()
    placed, cert = packing.pack(pieces, 60)
    check_packing(pieces.toPandas(), placed.toPandas(), 60)
    assert cert["bins"] == sorted(cert["bins"], reverse=True) and (len(cert["bins"]) > 1 or cert["bins"][-1] == cert["bound"])


def test_lower_bound_is_one():
    """Against an exact search on tiny cases, and where volume alone is too low."""

    def exact(items, cap):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins)}.values():
                if bins[b] + items[k] <= cap:
                    go(k + 1, [x + items[k] * (j == b) for j, x in enumerate(bins)])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best

    rng = random.Random(4)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        bound = packing.lower_bound(*np.unique(items, return_counts=True), 20)
        need = exact(items, 20)
        assert -(-bound // 1) <= need <= packing.best_fit_decreasing(np.array(items), 20).max() + 1
    assert packing.lower_bound(np.array([11]), np.array([7]), 20) == 7


def test_assemble(sample):
    pieces, placed, _ = packing.pack_documents(sample)
    seqs = packing.assemble(pieces, placed)
    total = pieces.agg(F.sum("length")).first()[0]
    assert seqs.agg(F.sum(F.length("ids"))).first()[0] == 4 * total


# 5


def test_token_counts(odd, empty, sample):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(token_counts.public_tokenizers.path(token_counts.PIECES))
    spaces = [" ", "  a  b ", "\n\n", "a\n b\n\nc", "▁x ▁", "漢\n漢 x", "a\tb\r\nc", "x" * 5000, " \n ", "\n漢"]
    for fallback in (True, False):
        u = Tokenizer(models.Unigram(vocab, 0, fallback))
        u.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
        counter = token_counts.Counter(vocab, byte_fallback=fallback)
        for t in [*spaces, *(r.text for r in odd.collect()), *(r.text for r in sample.collect())]:
            assert counter.count(t) == len(u.encode(t or "").ids), repr(t)[:80]
    # Ties: the earliest start wins; scores and counts by trying every segmentation.
    tied = [("<unk>", -5.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abb", -3.0), ("bb", -2.0)]
    u, c = Tokenizer(models.Unigram(tied, 0, False)), token_counts.Counter(tied, byte_fallback=False)
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("abbz漢") for _ in range(rng.randrange(1, 9)))
        assert c[w] == len(u.encode("▁" + w).ids), w
    assert token_counts.token_counts(odd).count() == len(ODD) and token_counts.token_counts(empty).count() == 0


# 6


def test_exact_dedup(odd, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.decisions(keyed(odd)).collect()
    size = Counter(norm(r[1]) for r in ODD)
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len(size)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): k for k in size}
    ids = {k: min((r[0] for r in ODD if norm(r[1]) == k and r[0] is not None), default=None) for k in size}
    for r in got:
        k = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (ids[k], size[k])
    stay = exact_dedup.deduplicate(odd)
    assert stay.columns == odd.columns and Counter(norm(r.text) for r in stay.collect()) == Counter(size.keys())
    assert exact_dedup.deduplicate(empty).count() == 0


def test_index_persists(spark, sample, tmp_path):
    path = f"file://{tmp_path}/index"
    own = lambda s, cond: keyed(s.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(cond))
    first = exact_dedup.decisions(own(spark, "doc_id < 100"), exact_dedup.DigestIndex(spark, path, buckets=3)).filter("kept").count()
    later = spark.newSession()  # knows the folder only
    index = exact_dedup.DigestIndex(later, path)
    assert index.manifest["buckets"] == 3 and index.rows().count() == first
    whole = exact_dedup.decisions(keyed(sample)).filter("kept").count()
    rest = exact_dedup.decisions(own(later, "doc_id >= 50"), index).filter("kept").count()
    assert first + rest == whole == index.rows().count() == index.rows().select("digest").distinct().count()


def test_batches_can_be_repeated(spark, sample, tmp_path, monkeypatch):
    """The same rows again, after a whole run and after runs that broke before or after a manifest was published."""
    found = lambda df: sorted(tuple(r) for r in df.collect())
    early, late = (keyed(sample.filter(c)) for c in ("doc_id < 120", "doc_id >= 60"))
    old = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    for broken in (0, 1, 2, 3):
        path = f"file://{tmp_path}/index{broken}"
        open_ = lambda path=path: exact_dedup.DigestIndex(spark, path, buckets=3, compact_after=2)
        want = found(exact_dedup.decisions(early, open_(), batch="early"))
        if broken:
            with monkeypatch.context() as m:
                publish, calls = exact_dedup.DigestIndex._publish, []

                def fail(self, appends, publish=publish, calls=calls, broken=broken):
                    calls.append(1)
                    if broken == 3:
                        publish(self, appends)
                    if broken == 3 or len(calls) == broken:
                        raise OSError("lost")
                    publish(self, appends)

                m.setattr(exact_dedup.DigestIndex, "_publish", fail)
                with pytest.raises(OSError, match="lost"):
                    exact_dedup.decisions(late, open_(), batch="late")
        got = found(exact_dedup.decisions(late, open_(), batch="late"))
        rest = rest if broken else got
        assert got == rest and found(exact_dedup.decisions(late, open_(), batch="late")) == got and found(exact_dedup.decisions(early, open_(), batch="early")) == want
        kept = [r for r in got if r[4]]
        assert kept and all(r[0] >= 120 for r in kept) and len(kept) + sum(r[4] for r in want) == open_().rows().count()
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/unnamed")
    first, again = (found(exact_dedup.decisions(early, index)) for _ in range(2))  # the name comes from the documents
    assert first == again and spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == old


def test_index_is_compacted(spark, sample, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, buckets=3, compact_after=3)
    rows = exact_dedup.digested(keyed(sample))
    for k in range(4):
        index.append_new(rows.filter(F.col("_row") % 4 == k), f"b{k}")
    assert len(index.manifest["appends"]) == 1
    assert [x.name for x in (tmp_path / "index").glob("append-*")] == index.manifest["appends"] and len(list((tmp_path / "index" / index.manifest["appends"][0]).glob("*.parquet"))) == 3
    again = exact_dedup.DigestIndex(spark, path)
    assert again.rows().count() == rows.select("digest").distinct().count()
    firsts = rows.groupBy("digest").agg(F.min("_row").alias("first_row"))
    with exact_dedup._sorted_buckets(spark):
        plan = firsts.join(again.parts()[0].hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("Exchange") :]  # of the new rows alone; the index has neither
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in right
    index.compact()
    assert len(exact_dedup.DigestIndex(spark, path).manifest["appends"]) == 1


# 7


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_weighted_sampling(sample, odd, empty):
    rows = sorted(((r.doc_id, r.text) for r in sample.collect()), key=lambda r: r[0])
    got = weighted_sampling.fingerprints_with_edits(keyed(sample))
    like = weighted_sampling.likeness
    got = got.select("doc_id", "n_chars", "edited_sha256", "s_text", like(F.col("s_text"), F.col("s_edited")).alias("e"), like(F.col("s_text"), F.col("s_next")).alias("x")).orderBy("doc_id").collect()
    texts = [t for _, t in rows]
    errors = []
    for k, r in enumerate(got):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.e - jaccard(t, edited), r.x - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07
    same = {}
    for t, r in zip(texts, got, strict=True):
        assert same.setdefault(t, r.s_text) == r.s_text
    out = weighted_sampling.fingerprints_with_edits(keyed(odd)).collect()
    assert len(out) == len(ODD) and len({tuple(r.s_text) for r in out if not (r.n_chars or 0) or r.doc_id == 5}) == 1
    assert weighted_sampling.fingerprints_with_edits(keyed(empty)).count() == 0


# 8


def slow_statistics(text):
    """The statistics of a text by plain loops."""
    import regex

    t, space = text or "", " \t\n\x0b\x0c\r"
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n = lambda f: sum(map(f, t))
    is_ = lambda cls: lambda c: bool(regex.match(cls, c))
    lines, chars = [x for x in t.split("\n") if x], len(t)
    share = lambda a, b: a / max(b, 1.0)
    starts = [x[0] for x in t.split("\n") if x]
    return {
        "log_chars": np.log1p(chars), "log_words": np.log1p(len(words)), "word_length": share(chars - n(lambda c: c in space), len(words)), "upper_share": share(n(is_(r"\p{Lu}")), chars),
        "digit_share": share(n(lambda c: c in "0123456789"), chars), "mark_share": share(n(lambda c: not regex.match(r"[\p{L}\p{N}]", c) and c not in space + ".,;:'\"()-"), chars), "bang_share": share(t.count("!"), len(words)),
        "pipe_share": share(t.count("|"), len(words)), "stop_share": share(t.count(".") + t.count(","), len(words)), "short_share": share(sum(len(w) <= 3 for w in words), len(words)), "letter_share": share(n(is_(r"\p{L}")), chars),
        "words_a_line": share(len(words), len(lines)), "distinct_lines": share(len(set(t.split("\n"))), max(len(lines), 1.0)), "distinct_words": share(len(set(re.split(r"[\x20\x09-\x0D]+", t))), len(words)), "lower_starts": share(sum(bool(regex.match(r"\p{Ll}", c)) for c in starts), len(lines)),
    }


def test_scores_equal_plain_evaluation(spark, sample):
    """The fitted rules on raw texts by plain loops give the query's scores."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    stats = quality_rules.with_statistics(sample)
    model = quality_rules.train(stats, labels)
    got = {r.doc_id: r.score for r in quality_rules.op8_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        s = slow_statistics(r.text)
        total = model.intercept + sum(w for rule, w in model.rules if all(s[name] <= at if upper else s[name] > at for name, upper, at in rule.bounds))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_lasso_is_the_least():
    rng = np.random.default_rng(4)
    x, n = rng.integers(0, 2, (60, 5)).astype(float), rng.integers(1, 9, 60).astype(float)
    y = (rng.random(60) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1])))).astype(float)
    loss = lambda b, w, lam: (n * np.logaddexp(0, -(2 * y - 1) * (b + x @ w))).sum() / n.sum() + lam * np.abs(w).sum()
    for lam in (0.0005, 0.02):
        b, w = quality_rules.lasso_logistic(x, y, n, lam, rounds=20_000)
        for scale in (0.3, 0.01, 0.001):
            assert all(loss(b, w, lam) <= loss(b + d[0], w + d[1:], lam) + 1e-9 for d in rng.normal(size=(200, 6)) * scale)


def test_quality(spark, sample, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_rules.with_statistics(docs)
    model = quality_rules.train(stats, labels)
    assert 0 < len(model.rules) < 80
    scored = stats.select("doc_id", quality_rules.is_held_out(F.col("doc_id")).alias("held"), model.score(F.col).alias("score")).join(labels, "doc_id").toPandas()
    held = scored[scored.held]
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.95
    ones, zeros = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (ones[:, None] > zeros[None, :]).mean() > 0.97
    assert all(quality_rules.is_held_out(F.lit(1)) is not None and h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(scored.doc_id, scored.held, strict=True))
    kept = quality_rules.filter_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)
    assert quality_rules.filter_quality(empty, labels).count() == 0
    one_class = quality_rules.train(stats, labels.filter("quality = 1"))
    assert one_class.rules == () and stats.limit(1).select(one_class.score(F.col)).first()[0] > 0.5


def test_rules_of_a_tree():
    text = "x\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n"
    rules = {r.bounds for r in quality_rules.tree_rules(text, ["a", "b"])}
    assert rules == {(("a", True, 1.5),), (("a", False, 1.5),), (("a", False, 1.5), ("b", True, 2.0)), (("a", False, 1.5), ("b", False, 2.0))}


# 9


def entropy(x):
    return -sum(p * np.log(p) for p in x if p > 0)


def slow_exponent(tokens, target, max_repeats):
    """The exponent by a fine search over a grid, then halving."""
    p = np.array(tokens, float) / sum(tokens)
    mix = lambda a: (w := (p / p.max()) ** a) / w.sum()
    grid = np.linspace(0, 60, 6001)
    over = next((a for a in grid if entropy(mix(a)) <= target + 1e-12), grid[-1])
    low, high = max(0.0, over - 0.01), over
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mix(mid)) <= target else (mid, high)
    spread = np.log(p.max() / p.min())
    return min(max(high, 1 - np.log(max_repeats) / spread), 1 + np.log(max_repeats) / spread)


@pytest.mark.parametrize("share, repeats", [(0.9, 1e9), (1.0, 3.0), (0.5, 1e9), (0.5, 2.0), (0.05, 1e9), (None, 1e9), (None, 1.5)])
def test_mixing_meets_its_target(spark, share, repeats):
    tokens = [900, 60, 40]
    src = spark.createDataFrame([("hot", 900, 90), ("b", 60, 6), ("c", 40, 4), (None, 0, 2)], "source string, tokens bigint, docs bigint")
    w = {r.source: r for r in mixing.source_weights(src, share, repeats).collect()}
    x = np.array([w[k].weight for k in ("hot", "b", "c")])
    natural = entropy(np.array(tokens) / sum(tokens))
    target = natural + 0.5 * (np.log(3) - natural) if share is None else share * np.log(3)
    assert x.sum() == pytest.approx(1) and w[None].weight == 0 and w[None].passes == 1
    assert w["hot"].exponent == pytest.approx(slow_exponent(tokens, target, repeats), abs=1e-6)
    assert min(w[k].passes for k in ("hot", "b", "c")) == pytest.approx(1) and max(w[k].passes for k in ("hot", "b", "c")) <= repeats + 1e-6
    assert w["hot"].bound in ("entropy", "repeats") and (w["hot"].bound == "repeats" or entropy(x) == pytest.approx(target, abs=1e-6))


def test_mixing_edges(spark):
    make = lambda tokens: spark.createDataFrame([(f"s{k}", t, 1) for k, t in enumerate(tokens)], "source string, tokens bigint, docs bigint")
    one = mixing.source_weights(make([7])).first()
    assert (one.exponent, one.bound, one.weight, one.passes) == (1.0, "natural", 1.0, 1.0)
    assert mixing.find_exponent(make([5, 5, 1]), 0.0, 1e300)[1] in ("steepest", "repeats")  # two equal sources: no mix has less than ln 2
    budgeted = {r.source: r for r in mixing.source_weights(make([900, 60, 40]), 1.0, 1.0, budget=500.0).collect()}
    assert max(r.passes for r in budgeted.values()) <= 1 + 1e-9 and sum(r.passes * r.tokens for r in budgeted.values()) == pytest.approx(500, abs=1e-4)
    assert mixing.find_exponent(make([900, 60, 40]), 1.0, 1.0, budget=5000.0) == (1.0, "repeats")
    many = spark.range(200_000).selectExpr("CAST(id AS STRING) AS source", "id % 1000 + 1 AS tokens", "1L AS docs")
    assert 0 < mixing.find_exponent(many)[0] < 1


def slow_mix(rows, passes, blocks, seed=42):
    """(row, pass) of all that is taken, with plain loops."""
    digest = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    out = []
    for s in {s for _, s, _ in rows}:
        own = [(r, t) for r, x, t in rows if x == s]
        full = int(passes[s])
        out += [(r, k) for r, _ in own for k in range(full)]
        left, held = (passes[s] - full) * sum(t for _, t in own), {}
        if passes[s] == full:
            continue
        for r, t in own:
            held.setdefault(int(digest(r, seed)[:13], 16) % blocks[s], []).append((r, t))
        seen = 0
        for b in sorted(held, key=lambda b: (digest(s or "", b, full, seed), b)):
            n = sum(t for _, t in held[b])
            if seen >= left:
                break
            if seen + n <= left:
                out += [(r, full) for r, _ in held[b]]
            else:
                at = seen
                for r, t in sorted(held[b], key=lambda x: (digest(x[0], full, seed), x[0])):
                    if at < left:
                        out.append((r, full))
                    at += t
            seen += n
    return sorted(out)


def test_mixing_equals_plain_loops(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "_row bigint, source string, tokens bigint")
    totals = df.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    weights = mixing.source_weights(totals, 0.999, 4.0).cache()
    taken = mixing.realise(df, weights, block=16).collect()
    w = {r.source: r for r in weights.collect()}
    want = slow_mix(rows, {s: r.passes for s, r in w.items()}, {s: max(1, -(-r.docs // 16)) for s, r in w.items()})
    assert sorted((r._row, r["pass"]) for r in taken) == want


def test_mixing_realised(spark, odd, empty):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", 1 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "_row bigint, source string, tokens bigint")
    taken, weights = mixing.mix_rows(df, target_entropy=0.99, max_repeats=4.0)
    w = {r.source: r for r in weights.collect()}
    got = taken.toPandas()
    for s, g in got.groupby("source"):
        times = g.groupby("_row").size()
        full = int(np.floor(w[s].passes))
        assert len(times) == w[s].docs and times.min() >= full and times.max() <= full + 1
        assert abs(g.tokens.sum() - w[s].passes * w[s].tokens) < 8  # at most one document over the budget
        assert not g.duplicated(["_row", "pass"]).any()
    small = mixing.realise(df, weights, block=16).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    assert all(abs(r.t - w[r.source].passes * w[r.source].tokens) < 8 for r in small)
    head = got.sort_values("place").head(len(got) // 4)
    for s, g in head.groupby("source"):
        assert g.tokens.sum() / head.tokens.sum() == pytest.approx(w[s].weight, abs=0.04)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() >= len(ODD)
    assert mixing.mix(empty).count() == 0


# 10


def slow_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (int(a) ^ int(fps[j])).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd, sample):
    for r in [*odd.collect(), *sample.collect()]:
        assert simhash.fingerprint((r.text or "").encode()) == slow_fingerprint(r.text)
    assert simhash.fingerprint(LONG.encode(), step=100) == slow_fingerprint(LONG)


def test_masks_cover():
    masks = simhash.covering_masks()
    rng = random.Random(6)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not flip & m & (2**64 - 1) for m in masks)


@pytest.mark.parametrize("limit, radius", [(65_536, 3), (3, 3), (65_536, 2), (3, 2), (3, 4)])
def test_near_classes(spark, limit, radius):
    rng = random.Random(8)
    fps = []
    for _ in range(12):  # chains and clouds of close patterns, and strangers
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    fps = list(dict.fromkeys(fps))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    reps = spark.createDataFrame(rows, "node bigint, fp bigint")
    found = {r.node: r.component for r in graph.connected_components(simhash.near_edges(reps, radius, bucket_limit=limit)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps, radius)


def test_near_documents(odd, empty, sample):
    rows = simhash.near_classes(keyed(sample)).orderBy("doc_id").collect()
    want = classes([r.fp % 2**64 for r in rows])
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in want]
    stay = simhash.deduplicate(sample)
    assert sorted(r.doc_id for r in stay.collect()) == sorted({rows[k].doc_id for k in want})
    out = simhash.near_classes(keyed(odd)).collect()
    assert len(out) == len(ODD) and len({r.component_row for r in out if r.doc_id in (3, 4, 5)}) == 1
    assert simhash.deduplicate(odd).columns == odd.columns and simhash.deduplicate(empty).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 620)] + [(7, 7)]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: find(i) for i in range(700) if find(i) != i}


def slow_shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def shingle_similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def test_near_stage_by_shingles(spark, odd, empty):
    import corpus_pipeline as cp

    rng = random.Random(10)
    texts = []
    for _ in range(40):  # copies with words replaced: similarities from about 0.6 to 0.97
        words = [f"w{rng.randrange(50_000)}" for _ in range(400)]
        texts.append(" ".join(words))
        for changed in (2, 6, 8, 20):
            copy = list(words)
            for k in rng.sample(range(0, 400, 5), changed):
                copy[k] = f"x{rng.randrange(50_000)}"
            texts.append(" ".join(copy))
    same = [f"s{k}" for k in range(300)]
    texts += [" ".join([*same, f"only{i}", *(f"t{i}x{j}" for j in range(20))]) for i in range(70)]  # one bucket, many hubs
    sets = [slow_shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in cp.near(spark, docs, "").collect())
    alike = lambda i, j: shingle_similarity(sets[i], sets[j]) >= 0.8
    assert not any(alike(i, j) for n, j in enumerate(kept) for i in kept[:n])
    gone = set(range(len(texts))) - set(kept)
    fps = [slow_fingerprint(t) for t in texts]
    assert all(any(alike(i, j) or (fps[i] ^ fps[j]).bit_count() <= 3 for i in range(j)) for j in gone)
    assert any((fps[i] ^ fps[j]).bit_count() > 3 and alike(i, j) for j in gone for i in range(j))
    assert cp.near(spark, odd, "").columns == odd.columns and cp.near(spark, empty, "").count() == 0


def test_bands_and_sets():
    a, b = "A b\tc d  e f g", "a b c d e f h"
    x, y = (minhash.shingle_set(t.encode()) for t in (a, b))
    assert len(x) == 3 and minhash.jaccard(x, y) == shingle_similarity(slow_shingles(a), slow_shingles(b)) == 0.5
    assert len(minhash.shingle_set(b"a b")) == 1 and len(minhash.shingle_set(None)) == 0
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**63, 20_000, np.uint64)
    assert (minhash.bands(pool) == minhash.bands(pool, step=77)).all()
    for _ in range(300):  # equal sets of shingles have equal sets of hashes, and others differ
        t, u = (" ".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(2))
        assert minhash.jaccard(*(minhash.shingle_set(x.encode()) for x in (t, u))) == shingle_similarity(slow_shingles(t), slow_shingles(u))
    met = sum((minhash.bands(p[:900]) == minhash.bands(p[100:])).any() for p in (rng.permutation(pool)[:1000] for _ in range(200)))
    assert met == 200  # similarity 0.8: at least one band in common


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
    mixed = spark.read.parquet(f"{tmp_path}/{len(cp.STAGES) - 2}").collect()
    lib = library(BYTE_BPE)
    assert docs.agg(F.sum("length")).first()[0] == sum(len(lib(r.text)) + 1 for r in mixed)
    near = spark.read.parquet(f"{tmp_path}/2").collect()
    assert {r.doc_id for r in near} == {r.doc_id for r in mixed}  # mixing loses no document
    assert len(set(classes([slow_fingerprint(r.text) for r in near]))) == len(near)
