"""Repair of conversations whose turns were lost, emptied, cut, repeated or put under the wrong role.

A conversation is well formed if its roles' initials follow ``GRAMMAR``. A generalised LR parser reads the turns with edits
as actions: keep a turn, give it the role user or assistant, delete it, or insert an empty turn of either role before
any turn and at the end. Stacks of automaton states share their tails; stacks that become equal are one, which
keeps the smallest (cost, audit), the audit being the edits' initials. Two different audits of equal cost that lead to
one stack are never each other's beginning, so the smaller one stays the smaller whatever is appended.

Only a turn's role initial and its first fault matter to the parser: one letter a turn. Turns are put in order by range,
so a conversation that holds a third of all rows is spread over many tasks. Each task parses its share in runs of ``RUN``
turns, from the one stack of an empty conversation where the run holds a whole one, else from every stack that the
grammar allows; a run then says what it costs to come from each stack to each other. Runs are joined conversation by
conversation, a step a run. The texts are read once more, in order, past their conversation's audit: as one digest over
a conversation's whole text is asked for, that reading is one task a conversation, which holds the audit and one batch.

Defined results: nulls are one space (a null ``turn`` comes first and counts for no gap; rows of a null ``conv_id`` are one
conversation). Rows of one turn go by role, then by the text's md5; equal rows are duplicates. A conversation without
rows has an empty audit. Other columns are not read. The order of the rows given does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

#: Productions over role initials. ``C``, a conversation, is the start; its empty right side is a conversation too.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "TP"), ("T", "P"), ("P", "ua"))
START = "C"
TURNS = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of a truncated turn that is not deleted.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What a text is blank without, and what ends a finished one.
SPACES, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
RUN = 512
#: A turn's letter: its initial (s, u, a or another) and its first fault.
INITIALS, FAULTS = "sua-", ("fine", "truncated", "duplicate", "blank")
LETTERS = "ABCDEFGHIJKLMNOP"
KEPT_RUNS = 50_000

Best = dict[int, tuple[int, str]]


class Automaton:
    """The states of the grammar's LR(0) items and the stacks of states that turns can lead to, numbered from 0, the
    stack of an empty conversation. The grammar must allow finitely many stacks."""

    def __init__(self, grammar: tuple[tuple[str, str], ...]):
        self.grammar = grammar
        self.heads = {head for head, _ in grammar}
        self.items: list[frozenset] = [self._closed({(k, 0) for k, (head, _) in enumerate(grammar) if head == START})]
        self.stacks: list[tuple[int, ...]] = [(0,)]
        self.moves: list[dict[str, list[int]]] = []
        self.accepting: set[int] = set()
        for number, stack in enumerate(self.stacks):  # grows on the way
            self.moves.append({symbol: [self._number(s) for s in self._after(stack, symbol)] for symbol in "sua"})
            if any(self.grammar[k][0] == START and at == len(self.grammar[k][1]) for k, at in self.items[stack[-1]]):
                self.accepting.add(number)

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            k, at = todo.pop()
            wanted = self.grammar[k][1][at:at + 1]
            for new in ((j, 0) for j, (head, _) in enumerate(self.grammar) if head == wanted and wanted in self.heads):
                if new not in items:
                    items.add(new)
                    todo.append(new)
        return frozenset(items)

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(k, at + 1) for k, at in self.items[state] if self.grammar[k][1][at:at + 1] == symbol}
        if not moved:
            return None
        items = self._closed(moved)
        if items not in self.items:
            self.items.append(items)
        return self.items.index(items)

    def _after(self, stack: tuple[int, ...], symbol: str) -> list[tuple[int, ...]]:
        """The stacks after a shift and any reductions, but those that allow neither a shift nor an end."""
        shifted = self._goto(stack[-1], symbol)
        found = [] if shifted is None else [(*stack, shifted)]
        for top in found:  # grows on the way
            for k, at in self.items[top[-1]]:
                head, body = self.grammar[k]
                if head != START and at == len(body):
                    below = top[:len(top) - at]
                    reduced = (*below, self._goto(below[-1], head))
                    if reduced not in found:
                        found.append(reduced)
        return [s for s in found if any(self.grammar[k][0] == START and at == len(self.grammar[k][1]) or
                                        self.grammar[k][1][at:at + 1] not in (self.heads | {""}) for k, at in self.items[s[-1]])]

    def _number(self, stack: tuple[int, ...]) -> int:
        if stack not in self.stacks:
            self.stacks.append(stack)
        return self.stacks.index(stack)


AUTOMATON = Automaton(GRAMMAR)


def _offer(frontier: Best, stack: int, cost: int, audit: str) -> bool:
    held = frontier.get(stack)
    if held is None or (cost, audit) < held:
        frontier[stack] = (cost, audit)
        return True
    return False


def _inserted(frontier: Best) -> Best:
    """With all stacks that inserted turns lead to."""
    todo = list(frontier)
    while todo:
        stack = todo.pop()
        cost, audit = frontier[stack]
        for symbol in TURNS:
            todo += [s for s in AUTOMATON.moves[stack][symbol] if _offer(frontier, s, cost + INSERT, audit + "I")]
    return frontier


def _step(frontier: Best, letter: str) -> Best:
    """The stacks after one more turn."""
    fault, initial = divmod(LETTERS.index(letter), len(INITIALS))
    after: Best = {}
    for stack, (cost, audit) in frontier.items():
        _offer(after, stack, cost + DELETE, audit + "D")
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        whole = cost + (TRUNCATED if FAULTS[fault] == "truncated" else 0)
        for s in AUTOMATON.moves[stack].get(INITIALS[initial], ()):
            _offer(after, s, whole, audit + "K")
        for symbol in TURNS:
            for s in AUTOMATON.moves[stack][symbol]:
                _offer(after, s, whole + RELABEL, audit + "R")
    return _inserted(after)


def parsed(letters: str, start: int = 0) -> Best:
    """The cheapest way from a stack, over a run of turns, to each other stack."""
    frontier = _inserted({start: (0, "")})
    for letter in letters:
        frontier = _step(frontier, letter)
    return frontier


@lru_cache(KEPT_RUNS)
def cheapest(letters: str) -> tuple[int, int, str]:
    """Last stack, cost and audit of the best repair of a whole conversation."""
    ends = parsed(letters)
    cost, audit, stack = min((*ends[s], s) for s in AUTOMATON.accepting if s in ends)
    return stack, cost, audit


class Joined:
    """Runs of one conversation, joined. Every stack holds its cost and a chain of audits back to the beginning."""

    def __init__(self):
        self.frontier: dict[int, tuple[int, tuple | None, str]] = {0: (0, None, "")}

    @staticmethod
    def _less(a: tuple, b: tuple) -> bool:
        """Of two chains of equal length; they are followed back to where they part."""
        if a[0] != b[0]:
            return a[0] < b[0]
        ours, theirs = [], []
        while a is not b and a is not None:
            ours.append(a[2])
            theirs.append(b[2])
            a, b = a[1], b[1]
        return "".join(reversed(ours)) < "".join(reversed(theirs))

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        """``paths``: from stack, to stack, cost, audit."""
        after: dict[int, tuple] = {}
        for start, end, cost, audit in paths:
            held = self.frontier.get(start)
            if held is not None:
                new = (held[0] + cost, held, audit)
                if end not in after or self._less(new, after[end]):
                    after[end] = new
        self.frontier = after

    def result(self) -> tuple[int, str]:
        best = None
        for stack in AUTOMATON.accepting & set(self.frontier):
            if best is None or self._less(self.frontier[stack], best):
                best = self.frontier[stack]
        cost, parts = best[0], []
        while best is not None:
            parts.append(best[2])
            best = best[1]
        return cost, "".join(reversed(parts))


def given(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (1) of every row, nulls of role and text as one space."""
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``given`` with the faults that a checksum of ``conv_id:turn`` draws; a row that is lost has no copies."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    return given(conversations).withColumn("draw", draw).select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") <= 1, "").when(F.col("draw") == 2, F.translate("text", "".join(ENDS), "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"))


def _print(text: str) -> Column:
    return F.unhex(F.md5(text))


def lettered(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, print) with their number of copies and the letters of the first copy and others."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    own = F.when(trimmed == "", FAULTS.index("blank")).when(
        ~F.substring(trimmed, -1, 1).isin(*ENDS), FAULTS.index("truncated")).otherwise(0)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1).otherwise(
        INITIALS.index("-"))
    key = ["conv_id", "turn", "role", "print"]
    turns = stage(rows.where("copies > 0").select(
        "conv_id", "turn", "role", _print("text").alias("print"), own.alias("fault"), initial.alias("initial"), "copies").groupBy(
        *key, "fault", "initial").agg(F.sum("copies").alias("copies")), "repair-turns")
    first = turns.groupBy("conv_id", "role", "print").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1").select(
        F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("print").alias("like"), "first")
    joined = turns.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as"))
                        & (F.col("print") == F.col("like")), "left")
    blank, duplicate = F.col("fault") == FAULTS.index("blank"), F.lit(FAULTS.index("duplicate"))
    again = F.when(blank, F.col("fault")).otherwise(duplicate)
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    letter = lambda fault: F.substring(F.lit(LETTERS), fault * len(INITIALS) + F.col("initial") + 1, F.lit(1))
    return stage(joined.select(*key, "copies", letter(F.when(later, again).otherwise(F.col("fault"))).alias("letter"),
                               letter(again).alias("other")), "repair-letters")


RUN_FIELDS = "conv_id {kind}, part int, seq int, letters string, low bigint, high bigint, turns bigint, " \
             "paths array<struct<start:int,end:int,cost:bigint,audit:string>>"


def runs(letters: DataFrame) -> DataFrame:
    """Runs of turns in order, by (conv_id, part, seq): letters, least, greatest and number of turn numbers, and paths."""
    key = ["conv_id", "turn", "role", "print"]
    kind = letters.schema["conv_id"].dataType.simpleString()
    paths = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, first of its conversation here, last of it here, letters, turn numbers) of each run."""
        held, numbers, conv, begun, fresh = [], [], None, False, True
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 4, 5, 6)]
            for conv_id, turn, copies, letter, other in zip(*columns, strict=True):
                if begun and conv_id != conv:
                    yield conv, fresh, True, "".join(held), numbers
                    held, numbers, fresh = [], [], True
                conv, begun, more = conv_id, True, [(letter, 1), (other, copies - 1)]
                for each, count in more:
                    while count:
                        if len(held) == RUN:
                            yield conv, fresh, False, "".join(held), numbers
                            held, numbers, fresh = [], [], False
                        n = min(count, RUN - len(held))
                        held += [each] * n
                        count -= n
                        if turn is not None and (not numbers or numbers[-1] != turn):
                            numbers.append(turn)
        if begun:
            yield conv, fresh, False, "".join(held), numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, seq = TaskContext.get().partitionId(), [], 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            kinds = [typed, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), paths]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                              ["conv_id", "part", "seq", "letters", "low", "high", "turns", "paths"])

        typed, first_conv = None, True

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal typed
            for batch in batches:
                typed = batch.column(0).type
                yield batch

        for conv_id, fresh, last, text, numbers in cut(watched()):
            if fresh and last and not first_conv:  # all of a conversation: others may go on in the parts around
                end, cost, audit = cheapest(text)
                ways = [(0, end, cost, audit)]
            else:
                ways = [(s, end, *way) for s in range(len(AUTOMATON.stacks)) for end, way in parsed(text, s).items()]
            first_conv = first_conv and not last
            found.append((conv_id, part, seq, text, numbers[0] if numbers else None, numbers[-1] if numbers else None, len(numbers),
                          [dict(zip(("start", "end", "cost", "audit"), w, strict=True)) for w in ways]))
            seq += 1
            if len(found) == 500:
                yield made()
                found.clear()
        if found:
            yield made()

    ordered = letters.select(*key, "copies", "letter", "other").repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, RUN_FIELDS.format(kind=kind))


class Conversation:
    """What the runs of one conversation say of it, then its turns, one after the other."""

    def __init__(self, conv_id):
        self.conv_id, self.joined, self.faults, self.illegal, self.last = conv_id, Joined(), [0] * len(FAULTS), 0, ""
        self.low = self.high = None
        self.turns = self.at = self.place = self.spoken = 0
        self.cost, self.audit, self.digest = 0, None, hashlib.sha256()

    def add_run(self, letters: str, low: int | None, high: int | None, turns: int, paths: list[dict]) -> None:
        self.joined.add([(p["start"], p["end"], p["cost"], p["audit"]) for p in paths])
        for k, letter in enumerate(LETTERS):
            self.faults[k // len(INITIALS)] += letters.count(letter)
        initials = self.last + "".join(INITIALS[LETTERS.index(x) % len(INITIALS)] for x in letters)
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        self.last = initials[-1:]
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.joined.result()

    def _due(self) -> str:
        self.spoken += 1
        return "user" if self.spoken % 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns that the audit inserts here."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._due(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand for one more given turn."""
        self.decide()
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._due(), text
        elif edit == "K":
            if role[:1] in TURNS:
                self._due()
            yield edit, role, text

    def close(self) -> Iterator[tuple[str, str, str]]:
        self.decide()
        yield from self.inserted()

    def counts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, truncated, duplicate, blank = self.faults
        return gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit


def _read_again(rows: DataFrame, ddl: str, of_turn, of_end) -> DataFrame:
    """Every conversation's runs, then its texts in order. ``of_turn(conversation, edit, role, text)`` and
    ``of_end(conversation)`` give result rows or none."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = runs(lettered(rows))
    none = lambda *names: [F.lit(None).alias(n) for n in names]
    heads = found.select("conv_id", F.lit(0).alias("kind"), "part", "seq", F.lit(None).cast("bigint").alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("print"),
                         F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), "letters", "low", "high", "turns", "paths")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), *none("part", "seq"), "turn", "role", _print("text").alias("print"), "text",
                        "copies", *none("letters", "low", "high", "turns", "paths"))
    texts = texts.select(*[F.col(f.name).cast(f.dataType) for f in heads.schema])
    order = ["conv_id", "kind", "part", "seq", "turn", "role", "print"]
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, typed, out, held = None, None, [], 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [typed, *[pa.string() if x.endswith("string") else pa.int64() for x in ddl.split(", ")[1:]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def ended(conversation: Conversation) -> list[tuple]:
            rows = [r for turn in conversation.close() for r in of_turn(conversation, *turn)]
            return rows + of_end(conversation)

        for batch in batches:
            typed = batch.column(0).type
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    if now is not None:
                        out += ended(now)
                    now = Conversation(row["conv_id"])
                if row["kind"] == 0:
                    now.add_run(row["letters"], row["low"], row["high"], row["turns"], row["paths"])
                    continue
                for _ in range(row["copies"]):
                    for turn in now.turn(row["role"], row["text"]):
                        out += of_turn(now, *turn)
                        held += len(row["text"])
                if len(out) >= 500 or held > 1 << 22:
                    if out:
                        yield made()
                    out, held = [], 0
        if now is not None:
            out += ended(now)
        if out:
            yield made()

    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(ddl.split(", ")[1:]))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``given`` or ``damaged`` rows: conv_id, place (from 1), edit (K, R or I), role, text."""
    def of_turn(conversation: Conversation, edit: str, role: str, text: str) -> list[tuple]:
        conversation.place += 1
        return [(conversation.conv_id, conversation.place, edit, role, text)]

    return _read_again(rows, "conv_id, place bigint, edit string, role string, text string", of_turn, lambda conversation: [])


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation, those whose rows have no copies included: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    def of_turn(conversation: Conversation, edit: str, role: str, text: str) -> list[tuple]:
        conversation.digest.update(f"{chr(10) if conversation.place else ''}{role}:{text}".encode())
        conversation.place += 1
        return []

    def of_end(conversation: Conversation) -> list[tuple]:
        return [(conversation.conv_id, *conversation.counts(), conversation.digest.hexdigest())]

    return _read_again(rows, "conv_id, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
                             "audit string, repaired_sha256 string", of_turn, of_end)
