"""Repair of conversations by generalised LR parsing over a grammar of roles.

A conversation is wanted as an optional system message and then whole exchanges of user and
assistant.  That grammar is left-recursive, so its LR stacks stay short; stacks are nodes of a
graph that share what lies beneath, each kept once.  Messages are read in order of turn; each may
be kept, given another role or deleted, and empty messages may be inserted anywhere, all at a
cost.  Of all ways to the same stack top the one with the least (cost, audit) stays, where the
audit is the string of action letters; D < I < K < R decides ties.  This is exact: two ways that
have read the same messages at the same cost have audits neither of which begins the other, so
what follows can't change their order.

Conversations of any length: messages are dealt by ranges of conversation and turn, and a task
repairs what lies whole within its range.  A piece at a range's edge becomes a table instead: for
each stack top before it and after it the least cost and the order of the audits.  These
tables, one a range, are joined along the conversation, which gives each piece its two tops; the pieces
are then repaired on their own.  Equal messages of one turn are merged and counted first, and repeats
are found by an aggregate that is joined back by salts.

Defined results: null roles and texts are one space; null turns come first, and the messages of one
turn are in order of role and text; a null id is a conversation; an empty role has no initial and
can't be kept; roles are taken by their initials as they are, so "unknown" reads as a user; long texts
are kept whole; of repeated rows the first counts, the others are duplicates; a conversation
without messages has an empty audit; an empty table gives an empty result; further columns, of any
name, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import attach, materialize

#: Productions; capitals are nonterminals, the first is the start.
GRAMMAR = (("C", ""), ("C", "Q"), ("Q", "sua"), ("Q", "ua"), ("Q", "Qua"))
#: What messages can be inserted or given another role as.
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the actions, and of a message that stays though it is cut off.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Messages, and characters of text, that one row of a result holds.
CHUNK, CHUNK_CHARS = 500, 1 << 22
#: Repeated messages up to which their digests are broadcast, of some 60 bytes each.
FEW = 100_000

MESSAGES = "array<struct<role:string,text:string,action:string,n:bigint>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns", "low", "high")
PIECE = f"conv string, part int, chunk int, open boolean, alone boolean, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, routes array<struct<entry:int,exit:int,cost:bigint,place:int>>, audit string, messages {MESSAGES}"
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("action", pa.string()), ("n", pa.int64())]))
_ROUTES = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("place", pa.int32())]))
_PIECE = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("open", pa.bool_()), ("alone", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("first", pa.string()), ("last", pa.string()), ("routes", _ROUTES), ("audit", pa.string()), ("messages", _MESSAGES)])


class Stacks:
    """The LR(0) automaton of a grammar with lookahead by what may follow, and the graph of its stacks.

    A node is a stack: a state on top of another node.  Equal ones are one node, numbered from 0,
    the empty stack, in order of discovery.
    """

    END = "$"

    def __init__(self, grammar: tuple = GRAMMAR, most: int = 1000):
        self.grammar, self.start = grammar, grammar[0][0]
        self.heads = {h for h, _ in grammar}
        self.terminals = sorted({x for _, body in grammar for x in body} - self.heads)
        self.follow = self._follow()
        self.states: list[frozenset] = [self._closure({(-1, 0)})]
        self.nodes: list[tuple[int, int | None]] = [(0, None)]
        self.known = {self.nodes[0]: 0}
        at = 0
        while at < len(self.nodes):
            for t in self.terminals:
                self.push(at, t)
            at += 1
            if len(self.nodes) > most:
                raise ValueError("the grammar's stacks have no bound: make it left-recursive")

    def _body(self, p: int) -> str:
        return self.start if p < 0 else self.grammar[p][1]

    def _closure(self, items: set) -> frozenset:
        out, left = set(items), list(items)
        while left:
            p, dot = left.pop()
            for q in [q for q, (h, _) in enumerate(self.grammar) if self._body(p)[dot : dot + 1] == h]:
                if (q, 0) not in out:
                    out.add((q, 0))
                    left.append((q, 0))
        return frozenset(out)

    def _follow(self) -> dict[str, set[str]]:
        """What may come after each nonterminal; symbols before the end of a body must not be empty."""
        follow, begin = {h: set() for h in self.heads}, {h: set() for h in self.heads}
        follow[self.start].add(self.END)
        for _ in range(len(self.grammar) + 1):
            for h, body in self.grammar:
                if body:
                    begin[h] |= begin[body[0]] if body[0] in self.heads else {body[0]}
                for x, after in zip(body, [*body[1:], self.END], strict=False):
                    if x in self.heads:
                        follow[x] |= follow[h] if after == self.END else begin[after] if after in self.heads else {after}
        return follow

    def _goto(self, state: int, symbol: str) -> int | None:
        items = {(p, dot + 1) for p, dot in self.states[state] if self._body(p)[dot : dot + 1] == symbol}
        if not items:
            return None
        new = self._closure(items)
        if new not in self.states:
            self.states.append(new)
        return self.states.index(new)

    def _on(self, node: int, symbol: str) -> int | None:
        state = self._goto(self.nodes[node][0], symbol)
        if state is None:
            return None
        at = (state, node)
        if at not in self.known:
            self.known[at] = len(self.nodes)
            self.nodes.append(at)
        return self.known[at]

    def _reduced(self, node: int, p: int) -> int | None:
        for _ in self._body(p):
            node = self.nodes[node][1]
        return self._on(node, self.grammar[p][0])

    def _complete(self, node: int) -> list[int]:
        return [p for p, dot in self.states[self.nodes[node][0]] if p >= 0 and dot == len(self._body(p))]

    def reductions(self, node: int, ahead: str) -> set[int]:
        """All stacks that ``node`` becomes by reductions that ``ahead`` allows, itself included."""
        out, left = {node}, [node]
        while left:
            now = left.pop()
            for p in self._complete(now):
                new = self._reduced(now, p) if ahead in self.follow[self.grammar[p][0]] else None
                if new is not None and new not in out:
                    out.add(new)
                    left.append(new)
        return out

    @functools.cache  # noqa: B019  one automaton a process
    def push(self, node: int, terminal: str) -> tuple[int, ...]:
        """The stacks after one more terminal; a state with one complete item and nothing else is reduced at once."""
        found = set()
        for before in self.reductions(node, terminal):
            new = self._on(before, terminal)
            while new is not None and len(self.states[self.nodes[new][0]]) == 1 and (done := self._complete(new)):
                new = self._reduced(new, done[0])
            if new is not None:
                found.add(new)
        return tuple(sorted(found))

    @functools.cache  # noqa: B019
    def accepts(self, node: int) -> bool:
        return any((-1, 1) in self.states[self.nodes[n][0]] for n in self.reductions(node, self.END))

    @functools.cache  # noqa: B019
    def inserts(self, node: int) -> dict[int, str]:
        """The fewest inserted roles that lead to each stack."""
        out, level = {node: ""}, [node]
        while level:
            after = []
            for n in level:
                for t in ROLES:
                    for m in self.push(n, t):
                        if m not in out:
                            out[m] = out[n] + t
                            after.append(m)
            level = after
        return out

    @functools.cache  # noqa: B019
    def steps(self, node: int, initial: str, cut: bool) -> list[tuple[int, int, str, str, str]]:
        """(stack, cost, letters, inserted roles, new role if any) of each way past one message that may stay.

        Nothing is inserted before a deletion: after it, it costs the same and comes earlier in order.
        """
        out = [(node, DELETE, "D", "", "")]
        for mid, roles in self.inserts(node).items():
            before, cost = "I" * len(roles), INSERT * len(roles) + CUT * cut
            if initial in self.terminals:
                out += [(m, cost, before + "K", roles, "") for m in self.push(mid, initial)]
            out += [(m, cost + REROLE, before + "R", roles, t) for t in ROLES for m in self.push(mid, t)]
        return out

    def search(self, items: list[tuple[str, bool, int]], entry: int = 0) -> tuple[dict, list[dict]]:
        """({stack: (cost, order of its audit)}, ways back) over messages (initial, cut, times deleted).

        A message with a count is one that must go, so often.
        """
        tops, back = {entry: (0, 0)}, []
        for initial, cut, gone in items:
            best: dict[int, tuple] = {}
            for node, (cost, place) in tops.items():
                for to, more, letters, roles, role in [(node, DELETE * gone, "D" * gone, "", "")] if gone else self.steps(node, initial, cut):
                    way = (cost + more, place, letters, node, roles, role)
                    if to not in best or way < best[to]:
                        best[to] = way
            order = sorted(best, key=lambda n: best[n][1:3])
            tops = {n: (best[n][0], k) for k, n in enumerate(order)}
            back.append({n: way[2:] for n, way in best.items()})
        return tops, back

    def tail(self, node: int) -> str | None:
        """The fewest roles to insert at the end, or None if nothing makes it whole."""
        ends = [r for n, r in self.inserts(node).items() if self.accepts(n)]
        return min(ends, key=lambda r: (len(r), r)) if ends else None


@functools.cache
def _stacks() -> Stacks:
    return Stacks()


def _best_end(tops: dict) -> tuple[int, int]:
    """(total cost, stack) of the best end."""
    s = _stacks()
    _, _, node = min((c + INSERT * len(t), place, n) for n, (c, place) in tops.items() if (t := s.tail(n)) is not None)
    return tops[node][0] + INSERT * len(s.tail(node)), node


class Run:
    """The messages of one conversation that one task has, in order."""

    def __init__(self, conv: str):
        self.conv, self.messages, self.items = conv, [], []
        self.count = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None}
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool) -> None:
        """``n`` equal messages; ``again``: one like them came in an earlier turn."""
        if not n:
            return
        c, end = self.count, text.rstrip(BLANKS)[-1:]
        if turn is not None and turn != c["high"]:
            c["turns"], c["low"], c["high"] = c["turns"] + 1, turn if c["low"] is None else c["low"], turn
        initial = role[:1]
        c["illegal"] += (self.last is not None and self.last + initial not in LEGAL) + n - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        gone = n if not end or again else n - 1
        if not end:
            c["blank"] += n
        else:
            c["duplicate"] += gone
        cut = bool(end) and not again and end not in ENDS
        c["truncated"] += cut
        self._item(role, text, "cut" if cut else "", 0 if gone == n else 1)
        self._item(role, text, "gone", gone)

    def _item(self, role: str, text: str, state: str, n: int) -> None:
        if n:
            self.messages.append((role, text if state != "gone" else "", state, n))
            self.items.append((role[:1], state == "cut", n if state == "gone" else 0))

    def repaired(self, back: list[dict], node: int, tail: str) -> tuple[list[str], list[list[tuple]]]:
        """(letters, messages) of each message's step, with what is inserted at the end."""
        letters, out = ["I" * len(tail)], [[(ROLES[t], "", "I", 1) for t in tail]]
        for k in range(len(self.messages) - 1, -1, -1):
            own, node, roles, role = back[k][node]
            letters.append(own)
            step = [(ROLES[t], "", "I", 1) for t in roles]
            if own[-1] != "D":
                step.append((ROLES[role] if role else self.messages[k][0], self.messages[k][1], own[-1], 1))
            out.append(step)
        return letters[::-1], out[::-1]


def _chunks(steps: Iterable[tuple[str, list[tuple]]]) -> Iterator[tuple[str, list[tuple]]]:
    """(audit, messages) of bounded size, at least one."""
    audit, held, chars = [], [], 0
    for letters, messages in steps:
        audit.append(letters)
        held += messages
        chars += sum(len(m[1]) for m in messages)
        if len(audit) >= CHUNK or chars >= CHUNK_CHARS:
            yield "".join(audit), held
            audit, held, chars = [], [], 0
    yield "".join(audit), held


def _rows(columns: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(columns, zip(*rows, strict=True), strict=True)], schema=schema)


_NAMES = ("role", "text", "action", "n")


def _piece(run: Run, part: int, open_: bool) -> Iterator[pa.RecordBatch]:
    """A run's rows of PIECE: repaired, or with its messages as they are and its routes."""
    s = _stacks()
    if open_:
        ways = {e: s.search(run.items, e)[0] for e in range(len(s.nodes))}
        routes = [{"entry": e, "exit": n, "cost": c, "place": k} for e, tops in ways.items() for n, (c, k) in tops.items()]
        steps = (("", [m]) for m in run.messages)
    else:
        tops, back = s.search(run.items)
        routes, (run.count["cost"], node) = [], _best_end(tops)
        steps = zip(*run.repaired(back, node, s.tail(node)), strict=True)
    found = list(_chunks(steps))
    for k, (audit, messages) in enumerate(found):
        head = [run.count[c] for c in COUNTS] if not k else [None] * len(COUNTS)
        row = (run.conv, part, k, open_, not open_ and len(found) == 1, *head, run.first, run.last, routes if not k else [], audit, [dict(zip(_NAMES, m, strict=True)) for m in messages])
        yield _rows(_PIECE.names, [row], _PIECE)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range of messages; the first and the last may go on in the ranges beside it."""
    from pyspark import TaskContext

    part, run, inner, held, size = TaskContext.get().partitionId(), None, False, [], 0
    for b in batches:
        for conv, turn, role, text, n, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run is None or conv != run.conv:
                if run is not None:
                    for x in _piece(run, part, not inner):
                        held.append(x)
                        size += x.nbytes
                    if len(held) >= CHUNK or size >= CHUNK_CHARS:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
                    inner = True
                run = Run(conv)
            run.add(turn, role, text, n, again)
    yield from held
    if run is not None:
        yield from _piece(run, part, True)


ROUTE = f"conv string, part int, entry int, exit int, end boolean, {', '.join(f'{c} long' for c in COUNTS)}"
_ROUTE = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("end", pa.bool_()), *((c, pa.int64()) for c in COUNTS)])


def _grouped(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that agree in the first ``width`` columns."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    names: list[str] = []

    def key(r: dict) -> tuple:
        names[:] = names or list(r)
        return tuple(r[n] for n in names[:width])

    return groupby(rows, key)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stack tops between the pieces of each conversation, and its counts; one row a range is held."""
    s = _stacks()
    for (conv,), rows in _grouped(batches):
        pieces = list(rows)
        least = {n: INSERT * len(t) for n in range(len(s.nodes)) if (t := s.tail(n)) is not None}
        ahead = [least]
        for p in reversed(pieces):
            now: dict[int, int] = {}
            for r in p["routes"]:
                if r["exit"] in ahead[-1]:
                    now[r["entry"]] = min(now.get(r["entry"], 1 << 62), r["cost"] + ahead[-1][r["exit"]])
            ahead.append(now)
        ahead.reverse()
        total = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "cost": ahead[0][0]}
        entry, last, out = 0, None, []
        for p, now, after in zip(pieces, ahead, ahead[1:], strict=False):
            ways = [r for r in p["routes"] if r["entry"] == entry and r["exit"] in after and r["cost"] + after[r["exit"]] == now[entry]]
            way = min(ways, key=lambda r: r["place"])
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                total[c] += p[c]
            if p["first"] is not None:
                total["illegal"] += last is not None and last + p["first"] not in LEGAL
                last = p["last"]
            if p["low"] is not None:
                total["turns"] -= p["low"] == total["high"]
                total |= {"low": p["low"] if total["low"] is None else total["low"], "high": p["high"]}
            out.append((conv, p["part"], entry, way["exit"], p is pieces[-1]))
            entry = way["exit"]
        yield _rows(_ROUTE.names, [(*o, *(total[c] if o[-1] else None for c in COUNTS)) for o in out], _ROUTE)


REPAIRED = f"conv string, part int, chunk int, alone boolean, audit string, messages {MESSAGES}"
_REPAIRED = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("alone", pa.bool_()), ("audit", pa.string()), ("messages", _MESSAGES)])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between known stack tops, repaired."""
    s = _stacks()
    for (conv, part), rows in _grouped(batches, 2):
        run, entry, exit_, end = Run(conv), 0, 0, False
        for r in rows:
            entry, exit_, end = r["entry"], r["exit"], r["end"]
            for m in r["messages"]:
                run._item(*(m[n] for n in _NAMES))
        _, back = s.search(run.items, entry)
        steps = zip(*run.repaired(back, exit_, s.tail(exit_) if end else ""), strict=True)
        for k, (audit, messages) in enumerate(_chunks(steps)):
            yield _rows(_REPAIRED.names, [(conv, part, k, False, audit, [dict(zip(_NAMES, m, strict=True)) for m in messages])], _REPAIRED)


def _conv(id_: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit(""))


def repair(df: DataFrame, id_: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, chunks).  ``copies`` names a column that says how often a row counts; conversations of nothing but zeros are reported as empty.

    Reports: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, chunks (how many).
    Chunks: conv, part, chunk, alone, messages; the repaired messages in order of part and chunk, with
    the action of each; ``alone`` where a conversation is one chunk, as most are.  ``conv`` is "=" and the id as text, or "" for a null id.
    """
    spark = df.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(_conv(id_).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    sized = lambda c: F.concat(F.char_length(c).cast("string"), F.lit(":"), c)
    digest = F.unhex(F.sha2(F.concat(sized("conv"), sized("role"), "text"), 256))
    merged = materialize(merged.withColumn("digest", digest), "messages")
    again = merged.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"), F.count("*").alias("m"))
    again = materialize(again.filter("m > 1").drop("m"), "repeats")
    few = again.limit(FEW + 1).count() <= FEW  # then they go to the messages, else both are dealt by digest
    marked = merged.join(F.broadcast(again), "digest", "left") if few else attach(merged, again, ["digest"], "turn", "left")
    later = F.col("at").isNotNull() & ~F.col("at.turn").eqNullSafe(F.col("turn"))
    marked = marked.select("conv", "turn", "role", "text", "n", later.alias("again"))
    ranges = ["conv", F.col("turn").asc_nulls_first(), "role"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that a range is a task
    dealt = marked.repartitionByRange(parts, *ranges, F.left("text", F.lit(64))).sortWithinPartitions(*ranges, "text")
    pieces = materialize(dealt.mapInArrow(_first_pass, PIECE), "pieces")

    cut = pieces.filter("open")
    heads = cut.filter("chunk = 0").select("conv", "part", *COUNTS, "first", "last", "routes")
    routes = materialize(heads.repartition(parts, "conv").sortWithinPartitions("conv", "part").mapInArrow(_choose, ROUTE), "routes")
    known = cut.select("conv", "part", "chunk", "messages").join(routes.select("conv", "part", "entry", "exit", "end"), ["conv", "part"])
    mended = known.repartition(parts, "conv", "part").sortWithinPartitions("conv", "part", "chunk").mapInArrow(_second_pass, REPAIRED)
    chunks = pieces.filter("NOT open").select("conv", "part", "chunk", "alone", "audit", "messages").unionByName(materialize(mended, "mended"))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    counts = pieces.filter("NOT open AND chunk = 0").select("conv", *COUNTS).unionByName(routes.filter("end").select("conv", *COUNTS))
    # A conversation's audit is one string by definition; it comes together from its chunks.
    audits = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "chunk", "audit"))).alias("a"))
    audits = audits.select("conv", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"), F.size("a").alias("chunks"))
    reports = counts.join(audits, "conv").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "chunks")
    return reports, chunks.select("conv", "part", "chunk", "alone", "messages")


def chunk_lines(messages: str = "messages") -> Column:
    """``role:text`` of a chunk's messages, joined by newlines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def message_digests(chunks: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's lines.

    A digest is sequential, so the chunks of a long conversation stream through one task, a chunk
    at a time; others are digested where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _grouped(batches):
            h, any_ = hashlib.sha256(), False
            for r in rows:
                if r["lines"] is not None:
                    h.update((b"\n" if any_ else b"") + r["lines"].encode())
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([h.hexdigest()])], names=["conv", "sha256"])

    whole = chunks.filter("alone").select("conv", F.sha2(F.encode(chunk_lines(), "UTF-8"), 256).alias("sha256"))
    lines = chunks.filter("NOT alone").select("conv", "part", "chunk", F.when(F.size("messages") > 0, chunk_lines()).alias("lines"))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.unionByName(lines.repartition(parts, "conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(run, "conv string, sha256 string"))


def damaged(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) with faults put in by a checksum of id and turn; ``copies`` says how often a row is there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its result for every damaged conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    reports, chunks = repair(damaged(rows), copies="copies")
    found = reports.join(message_digests(chunks), "conv")
    id_ = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType)
    return found.select(id_.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
