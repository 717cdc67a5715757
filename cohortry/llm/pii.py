"""Personal data by weak supervision.

Three labelers propose candidate spans in each text: regular expressions (the strict base
patterns, what these match but then fails a check such as Luhn, and looser patterns), a
gazetteer (numbers and addresses that begin or end as known codes, issuers, networks and
domains do, however written), and context (what follows a cue word).  Five votes are cast on
each candidate: the strict pattern (for, against where its check fails, or none), the
gazetteer, cue words before the span, misleading words before it, and the span's edges.  Expectation-maximisation over all candidates of all documents estimates each labeler's
reliability per kind and, with it, the probability that a candidate is personal data.  A
logistic classifier over the votes and the span's shape is fitted to these probabilities;
candidates that it accepts are added.  Base spans always stay.

What the corpus contributes are counts of vote and shape patterns, a bounded table however
many documents there are; both fits run on it.

Defined results: a null text is empty; whole texts of any length are searched; spans are
offsets of code points, the end exclusive; within a kind they don't overlap: base spans go
first, then those of looser patterns, gazetteer, context and failed checks, and of one
labeler's the leftmost; an added span touches no base span of any kind; a score equal to the
limit is accepted; repeated rows are rows of their own; an empty table gives an empty result;
other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Characters before a span that are searched for cue words; score from which a candidate is added.
WINDOW, LEAST = 40, 0.7

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

AT_FORM = re.compile(r" ?[\[({] ?at ?[\])}] ?| at ", re.IGNORECASE)
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Runs of hexadecimal digits and colons; ``long_ip`` tells which are addresses.
LONG_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: National numbers in other groupings: a trunk zero or an area in brackets first, or pairs, or Spanish groups of three.
NATIONAL_PHONE = re.compile(
    r"(?<![0-9A-Za-z+.,/-])(?:"
    r"0[1-9](?:[ .-][0-9]{2}){4}"  # 01 23 45 67 89
    r"|\(?0[1-9][0-9]{1,4}\)?[ ./-]{1,3}[0-9]{3,8}(?:[ .-][0-9]{2,5}){0,3}"  # 030 1234567, (0171) 234 56 78
    r"|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|[89][0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2}"  # 612 345 678, 91 234 56 78
    r"|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}"  # (11) 4321-1234
    r")(?![0-9A-Za-z])"
)

#: Gazetteers; fixed values.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk us eu ca au jp cn in br mx nl be ch at se no dk fi pl pt".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "90", "91")
CARD_ISSUERS = ("4", "34", "37", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "63", "64", "65", "67")
_CODES = "|".join(sorted(CALLING_CODES, reverse=True))
#: What the gazetteer proposes: known endings and beginnings in other spellings than the strict ones.
LISTED = {
    0: re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+ ?\. ?(?:[A-Za-z0-9-]+ ?\. ?)*(?:{'|'.join(sorted(TOP_DOMAINS))})(?![A-Za-z0-9-])", re.IGNORECASE),
    1: re.compile(r"(?<![0-9A-Za-z.])(?:10|172[.-](?:1[6-9]|2[0-9]|3[01])|192[.-]168)(?:[.-](?:[0-9]{1,3}|x|\*)){2,3}(?![0-9A-Za-z.-])"),
    2: re.compile(r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9A-Za-z])"),
    3: re.compile(rf"(?<![0-9A-Za-z+])(?:\+|00)(?:{_CODES})(?:[ ./()-]{{1,3}}[0-9]{{2,8}}){{2,5}}(?![0-9A-Za-z])"),
}
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(ip|host|server|address|login|client)\b", re.IGNORECASE),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|payment)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(tel|telephone|phone|call|mobile|cell|fax|whatsapp)\b", re.IGNORECASE),
}
MISLEADING = re.compile(r"\b(version|release|isbn|issn|doi|order|invoice|serial|model|section|figure|part|build)\b", re.IGNORECASE)


#: What context proposes: the group after a cue word.
AFTER_CUE = {
    0: re.compile(r"\b(?:e-?mail|mail|contact)\b(?: address)?(?: ?[:=] ?| )([A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)", re.IGNORECASE),
    1: re.compile(r"\b(?:ip|host|server|client)\b(?: address)? ?[:=]? ?([0-9]{1,3}(?:[.,_-][0-9]{1,3}){3})(?![0-9])", re.IGNORECASE),
    2: re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit)\b(?: number| no\.?)? ?[:=#]? ?([0-9](?:[ ./_-]?[0-9])+)", re.IGNORECASE),
    3: re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp)\b\.? ?(?:no\.?|number|me|at|on)? ?[:=#]? ?(\+?\(?[0-9](?:[ ()./-]{0,2}[0-9])+)", re.IGNORECASE),
}
#: Digits that a proposal of each kind has.
DIGITS = {0: (0, 1 << 30), 1: (2, 12), 2: (13, 19), 3: (7, 15)}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def long_ip(s: str) -> bool:
    """Whether a run of hexadecimal digits and colons is an address of eight groups, or of fewer around one ``::``."""
    left, gap, right = s.partition("::")
    groups = [g for part in (left, right) if part for g in part.split(":")]
    fits = 1 <= len(groups) <= 7 if gap else len(groups) == 8
    return fits and all(1 <= len(g) <= 4 for g in groups)


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, in time linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def spelt_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with a spelt-out @, found from each of them outwards as in ``emails``."""
    out, floor, at = [], 0, AT_FORM.search(text)
    while at:
        start = at.start()
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = SPELT_DOMAIN.match(text, at.end()) if start < at.start() else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = AT_FORM.search(text, m.end() if m else at.start() + 1)
    return out


def strict_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base spans, matches that fail their kind's check) of each kind by the strict patterns."""
    base: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    failed: list[list[tuple[int, int]]] = [[], [], [], []]
    if not DIGIT.search(text):
        return base, failed
    if "." in text:
        for m in IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
            (base if fits else failed)[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19:
            (base if luhn(d) else failed)[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            (base if 8 <= len(_digits(m[0])) <= 15 else failed)[3].append(m.span())
    return base, failed


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the strict patterns."""
    return strict_spans(text)[0]


def pattern_spans(text: str) -> list[list[tuple[int, int]]]:
    """What the looser patterns match, by kind."""
    found: list[list[tuple[int, int]]] = [spelt_emails(text), [], [], []]
    if "::" in text or text.count(":") >= 7:
        found[1] = [m.span() for m in LONG_IP.finditer(text) if long_ip(m[0])]
    if DIGIT.search(text):
        found[2] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d)]
        found[3] = [m.span() for m in LOCAL_PHONE.finditer(text)] + [m.span() for m in NATIONAL_PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 13]
    return found


def _proposed(text: str, kind: int, at: re.Pattern, group: int) -> list[tuple[int, int]]:
    low, high = DIGITS[kind]
    return [m.span(group) for m in at.finditer(text) if low <= len(_digits(m[group])) <= high]


def listed_spans(text: str) -> list[list[tuple[int, int]]]:
    """What the gazetteer proposes, by kind."""
    wanted = ["@" in text, *[bool(DIGIT.search(text))] * 3]
    return [_proposed(text, k, LISTED[k], 0) if wanted[k] else [] for k in range(len(KINDS))]


def context_spans(text: str) -> list[list[tuple[int, int]]]:
    """What follows a cue word and may be meant, by kind."""
    wanted = ["@" in text, *[bool(DIGIT.search(text))] * 3]
    return [_proposed(text, k, AFTER_CUE[k], 1) if wanted[k] else [] for k in range(len(KINDS))]


class _Taken:
    """Spans without overlap, kept in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.reach = [], []
        for s, e in sorted(spans):
            self.starts.append(s)
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)  # spans of different kinds may overlap

    def free(self, span: tuple[int, int]) -> bool:
        k = bisect_left(self.starts, span[1]) - 1
        return k < 0 or self.reach[k] <= span[0]


def added_candidates(text: str, base: list[list[tuple[int, int]]], failed: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, labeler) of the candidates that touch no base span, without overlap within a kind."""
    taken, out = _Taken([s for spans in base for s in spans]), []
    proposals = (("p", pattern_spans(text)), ("g", listed_spans(text)), ("c", context_spans(text)), ("f", failed))
    for k in range(len(KINDS)):
        own: list[tuple[int, int]] = []
        for labeler, spans in proposals:
            before, last = _Taken(own), -1
            for s, e in sorted(set(spans[k])):
                if s >= last and taken.free((s, e)) and before.free((s, e)):
                    own.append((s, e))
                    out.append((k, s, e, labeler))
                    last = e
    return out


def looser_spans(text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Candidates of each kind besides the base spans and those that fail a check."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    for k, s, e, _ in sorted(added_candidates(text, base, [[], [], [], []])):
        found[k].append((s, e))
    return found


def votes(text: str, kind: int, start: int, end: int, labeler: str) -> str:
    """The pattern of a candidate: a vote of each labeler (+, -, or 0 to abstain) and the span's shape.

    ``labeler`` is b for a base span, else the one that proposed it.
    """
    span, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = _digits(span)
    if kind == 0:
        known = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower() in TOP_DOMAINS
    elif kind == 1:
        known = not span.startswith(("0.", "255."))
    elif kind == 2:
        known = digits.startswith(CARD_ISSUERS)
    else:
        known = digits.lstrip("0").startswith(CALLING_CODES)
    edges = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    v = [
        {"b": "+", "f": "-"}.get(labeler, "0"),
        "+" if known else "-",
        "+" if CUES[KINDS[kind]].search(before) else "0",
        "-" if MISLEADING.search(before) else "0",
        "+" if edges else "-",
    ]
    separators = sum(not c.isalnum() for c in span)
    return f"{kind}{''.join(v)}{min(len(digits) // 4, 4)}{min(separators, 4)}"


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, pattern) of the candidates of a text, by kind and start."""
    base, failed = strict_spans(text)
    out = [(k, s, e, "b") for k, spans in enumerate(base) for s, e in spans] + added_candidates(text, base, failed)
    return [(k, s, e, by == "b", votes(text, k, s, e, by)) for k, s, e, by in sorted(out)]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found) with the candidates of each document."""
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("cell", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kind]
        for b in batches:
            rows = [[dict(zip(names, c, strict=True)) for c in find(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,cell:string>>")


VOTERS = 5
#: Votes (-, 0, +) of each class and labeler counted before any are seen: labelers are right more
#: often than not.  The strict pattern's count as much again as all that are seen of a kind: what fails its
#: checks (Luhn, octets, digits) is hardly ever such a number, however much it looks like one.
PRIOR = np.array([[[20.0, 0.0, 1.0], *[[4.0, 0.0, 1.0]] * 4], [[1.0, 0.0, 20.0], *[[1.0, 0.0, 4.0]] * 4]])


def first_guess(cell: str) -> float:
    """Where EM starts: the strict pattern's vote counts most, then the balance of the others; class 1 means personal data."""
    v = ["-0+".index(x) - 1 for x in cell[1 : VOTERS + 1]]
    return min(0.95, max(0.05, 0.5 + 0.4 * v[0] + 0.1 * sum(v[1:])))


def reliabilities(cells: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (probability of each cell, P(vote | class) per kind and labeler).

    Each labeler votes independently given the class; one that abstains says nothing.
    """
    kind = np.array([int(c[0]) for c in cells])
    vote = np.array([["-0+".index(v) for v in c[1 : VOTERS + 1]] for c in cells])
    p = np.array([first_guess(c) for c in cells])
    table = np.zeros((len(KINDS), 2, VOTERS, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            for c, w in ((1, p), (0, 1 - p)):
                for j in range(VOTERS):
                    strength = 1.0 if j else 1.0 + counts[own].sum() / PRIOR[c, 0].sum()
                    seen = PRIOR[c, j] * strength + np.bincount(vote[own, j], (w * counts)[own], 3)
                    seen[1] = 0.0
                    table[k, c, j] = seen / seen.sum() + (0.0, 1.0, 0.0)  # an abstention has likelihood 1 in both classes
        share = np.array([((p * counts)[kind == k].sum() + 1) / (counts[kind == k].sum() + 2) for k in range(len(KINDS))])
        each = np.stack([np.log(table)[kind, c][np.arange(len(cells))[:, None], np.arange(VOTERS), vote].sum(axis=1) for c in (0, 1)])
        odds = np.log(share[kind]) - np.log1p(-share[kind]) + each[1] - each[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table


def _features(cells: list[str]) -> np.ndarray:
    """One-hot kinds, and votes and shapes by kind."""
    rows = []
    for c in cells:
        kinds = np.eye(4)[int(c[0])]
        v = np.array(["-0+".index(x) - 1 for x in c[1 : VOTERS + 1]], float)
        own = np.concatenate([[1.0], v, np.eye(5)[int(c[-2])], np.eye(5)[int(c[-1])]])
        rows.append(np.outer(kinds, own).ravel())
    return np.array(rows)


def classifier(cells: list[str], p: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Probability of each cell by logistic regression on soft labels, fitted by Newton's method."""
    x, w = _features(cells), np.zeros(len(_features(cells[:1])[0]))
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - mu)) - penalty * w
        hessian = (x * (counts * mu * (1 - mu))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def personal_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, spans) with the accepted spans of each document: kind, start, end, base."""
    found = materialize(candidates(docs), "candidates")
    table = found.select(F.explode("found").alias("c")).groupBy("c.cell").agg(F.count("*").alias("n")).orderBy("cell").toPandas()  # at most 4 * 3^5 * 25 rows
    accepted: list[str] = []
    if len(table):
        cells, counts = table["cell"].tolist(), table["n"].to_numpy(float)
        p, _ = reliabilities(cells, counts)
        scores = classifier(cells, p, counts)
        accepted = [c for c, s in zip(cells, scores, strict=True) if s >= least and c[1] != "+"]
    added = F.array(*[F.lit(c) for c in accepted]).cast("array<string>")
    return found.select("doc_id", F.filter("found", lambda c: c["base"] | F.array_contains(added, c["cell"])).alias("spans"))


def as_text(spans):
    """kind:start:end of each span, by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _of_kind(k: int):
    return lambda s: s["base"] & (s["kind"] == k)


def op2_pii_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

