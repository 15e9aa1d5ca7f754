"""Repair of conversations: the cheapest edits that make the roles of the turns ``(s?(ua)+)?``, and their audit.

A turn's first fault counts: blank (no word in it), duplicate (its role and text were seen earlier in the conversation),
truncated (its last character, white space aside, ends no sentence). Edits are Keep (0), Rerole to user or assistant (3),
Delete (4; the only one for blank and duplicate turns) and Insert of an empty user or assistant turn (3); a truncated turn
that stays adds 3. The audit is the edits' initials in order; of equally cheap audits the ASCII-least is taken.

The audit is found by a persistent dynamic program over the states of the role pattern. Its entries are nodes of one tree:
a node adds one initial to its parent, so all audits share their prefixes. A node knows its ancestors at powers of two and
a rolling hash; two equally cheap audits are compared by a search for their longest common prefix along those ancestors, and
equal hashes are verified by walking down to a common node. Equally cheap audits of the same turns and state are never
prefixes of each other (a longer one would have more inserts), so the lesser stays the lesser however both go on. States
that cannot win any more are dropped, and a prefix shared by all live audits is settled and its nodes are let go.

The first pass streams turns without their texts, sorted by conversation and turn; the second streams the texts behind the
conversation's audit and applies the edits turn by turn. So a conversation passes through one task of each pass, which holds
its audit and the unsettled nodes, never its texts. The table is read twice and must give the same rows each time.

Cases: a null role or text is one space; turns are ordered by turn (null first), then role and text; repeated rows are
duplicates of the first; rows with a null conversation id form one conversation; roles are told apart by their first
character, and one other than s, u, a can only be changed or deleted; an empty table gives no rows. Other input columns are
not carried.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the role pattern: nothing yet, after s, after u, after a.
EMPTY, S, U, A = range(4)
#: Rolling hash of audits.
BASE, MODULUS = 1_000_003, (1 << 61) - 1
#: Turns after which the shared prefix is settled.
SETTLE = 4096
FINE, BLANK, DUPLICATE, CUT = range(4)


class Audits:
    """The tree of audit prefixes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.clear()

    def clear(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        node, up, k = len(self.letter), [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.modulus)
        self.up.append(tuple(up))
        return node

    def at_depth(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two audits of one length are equal; equal hashes are not taken on trust."""
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def parted(self, x: int, y: int) -> tuple[int, int]:
        """The first nodes in which two audits differ; the same node twice if one is a prefix of the other."""
        depth = min(self.depth[x], self.depth[y])
        x, y = self.at_depth(x, depth), self.at_depth(y, depth)
        if self.same(x, y):
            return x, x
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return x, y

    def less(self, x: int, y: int) -> bool:
        a, b = self.parted(x, y)
        return self.depth[x] < self.depth[y] if a == b else self.letter[a] < self.letter[b]

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def rebuilt(self, live: list[int]) -> tuple[str, list[int]]:
        """Cut off the prefix that all live audits share; it, and the live nodes in the tree that is left."""
        root = live[0]
        for node in live[1:]:
            a, b = self.parted(root, node)
            root = a if a == b else self.up[a][0]
        settled, paths = self.text(root), {}
        for node in live:
            while self.depth[node] > self.depth[root]:
                paths[node] = self.up[node][0]
                node = self.up[node][0]
        order = sorted(paths, key=self.depth.__getitem__)
        letters = [self.letter[n] for n in order]
        self.clear()
        new = {}
        for node, letter in zip(order, letters, strict=True):
            new[node] = self.add(new.get(paths[node], 0), letter)
        return settled, [new.get(n, 0) for n in live]


class Repair:
    """One conversation, turn by turn: for each state of the roles, the cheapest cost and its least audit."""

    def __init__(self, modulus: int = MODULUS):
        self.tree, self.settled = Audits(modulus), []
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.turns = 0

    def least(self, *ways: tuple[int, int, str]) -> tuple[int, int] | None:
        """Of ways (cost, node, letter to add, "" for none), the cheapest and then least."""
        if not ways:
            return None
        cost = min(w[0] for w in ways)
        won = None
        for c, node, letter in ways:
            if c == cost:
                node = self.tree.add(node, letter) if letter else node
                if won is None or self.tree.less(node, won):
                    won = node
        return cost, won

    def stepped(self, states: tuple[int, ...], letter: str, cost: int) -> list[tuple[int, int, str]]:
        return [(self.best[s][0] + cost, self.best[s][1], letter) for s in states if self.best[s] is not None]

    def insert(self) -> None:
        """Inserts before the next turn; no more than two in a row can be part of a cheapest audit."""
        self.best[U] = self.least(*self.stepped((U,), "", 0), *self.stepped((EMPTY, S, A), "I", INSERT))
        self.best[A] = self.least(*self.stepped((A,), "", 0), *self.stepped((U,), "I", INSERT))

    def drop(self) -> None:
        """Leave out states that lose against going on from another one, whatever follows."""
        cost = [b[0] if b is not None else 1 << 62 for b in self.best]
        if cost[A] + DELETE < cost[EMPTY]:
            self.best[EMPTY] = None
        if cost[A] < cost[S]:
            self.best[S] = None
        if cost[A] + INSERT < cost[U]:
            self.best[U] = None
        if cost[U] + INSERT < cost[A]:
            self.best[A] = None

    def add(self, initial: str, fault: int) -> None:
        self.insert()
        stays = TRUNCATED if fault == CUT else 0
        new = [self.stepped((q,), "D", DELETE) for q in (EMPTY, S, U, A)]
        if fault not in (BLANK, DUPLICATE):
            new[U] += self.stepped((EMPTY, S, A), "R", REROLE + stays)
            new[A] += self.stepped((U,), "R", REROLE + stays)
            if initial == "s":
                new[S] += self.stepped((EMPTY,), "K", stays)
            elif initial == "u":
                new[U] += self.stepped((EMPTY, S, A), "K", stays)
            elif initial == "a":
                new[A] += self.stepped((U,), "K", stays)
        self.best = [self.least(*ways) for ways in new]
        self.drop()
        self.turns += 1
        if self.turns % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        states = [q for q in range(4) if self.best[q] is not None]
        settled, nodes = self.tree.rebuilt([self.best[q][1] for q in states])
        self.settled.append(settled)
        for q, node in zip(states, nodes, strict=True):
            self.best[q] = (self.best[q][0], node)

    def result(self) -> tuple[int, str]:
        self.insert()
        cost, node = self.least(*self.stepped((EMPTY, A), "", 0))
        return cost, "".join(self.settled) + self.tree.text(node)


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Measured:
    """Counts and repair of one conversation's turns, in order."""

    def __init__(self):
        self.repair, self.faults, self.illegal, self.last = Repair(), [0, 0, 0, 0], 0, None
        self.first_turn = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.turn
            self.turn = turn
        self.repair.add(initial, fault)

    def result(self) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, *self.repair.result()


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, at, ids, found, kind = None, None, [], [], None

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 7
        arrays = [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *NAMES, "audit"])

    for batch in batches:
        kind = batch["conv_id"].type
        names = ["conv_id", "turn", "initial", "fault"]
        for conv, *row in zip(*(batch[n].to_pylist() for n in names), strict=True):
            if current is None or conv != at:
                if current is not None:
                    ids.append(at)
                    found.append(current.result())
                current, at = Measured(), conv
            current.add(*row)
        if found:
            yield batch_of()
            ids, found = [], []
    if current is not None:
        ids, found = [at], [current.result()]
        yield batch_of()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Behind each audit, its conversation's turns in order: the turns that the edits leave."""
    conv, audit, at, last, place = None, "", 0, "", 0
    out: list[tuple] = []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal last, place
        last = role[:1]
        out.append((conv, place, edit, role, text))
        place += 1

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            put("insert", "assistant" if last == "u" else "user", "")

    for batch in batches:
        kind = batch["conv_id"].type
        names = ["conv_id", "audit", "role", "text"]
        for key, given, role, text in zip(*(batch[n].to_pylist() for n in names), strict=True):
            if given is not None:
                inserts()
                conv, audit, at, last, place = key, given, 0, "", 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                put("keep", role, text)
            elif edit == "R":
                put("rerole", "assistant" if last == "u" else "user", text)
        if out:
            yield _turns(out, kind)
            out = []
    inserts()
    if out:
        yield _turns(out, kind)


def _turns(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "edit", "role", "text"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, from turns in order."""
    digest, at, kind, found = None, None, None, []
    for batch in batches:
        kind = batch["conv_id"].type
        for conv, place, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if digest is not None:
                    found.append((at, digest.hexdigest()))
                digest, at = sha256(), conv
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (kind, pa.string()), strict=True)], ["conv_id", "sha256"])
            found = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def audited(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, gaps (missing turn numbers), blank, duplicate, truncated (turns by first fault),
    illegal (neighbouring roles that do not follow each other), cost and audit of the repair."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    ).repartition("conv_id")
    # Dealt by conversation already, so that the window needs no shuffle of its own.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    told = narrow.withColumn("seen", seen).withColumn("fault", fault)
    told = told.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    fields = [T.StructField("conv_id", turns.schema[conv_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in NAMES] + [T.StructField("audit", T.StringType())]
    return told.select("conv_id", "turn", "initial", "fault").mapInArrow(_audited, T.StructType(fields))


def repaired_turns(
    turns: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The turns after the edits of ``audits``: conv_id, place (from 0), edit (keep, rerole, insert), role, text; each
    conversation's turns lie in one partition, in order."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:-1]], "audit")
    both = rows.unionByName(heads).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    kind = T.StructType(
        [T.StructField("conv_id", turns.schema[conv_col].dataType), T.StructField("place", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]
    )
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_applied, kind)


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The audits (a stored table) and the repaired turns."""
    names = (conv_col, turn_col, role_col, text_col)
    audits = written(audited(turns, *names), "audits")
    return audits, repaired_turns(turns, audits, *names)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; of turns as ``repaired_turns`` gives them, in order."""
    kind = T.StructType([repaired.schema["conv_id"], T.StructField("sha256", T.StringType())])
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(_digested, kind)
