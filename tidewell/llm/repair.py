"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation is sound if its roles read ``(system? (user assistant)+)?``. Rows may be kept, given another role,
deleted, and rows may be inserted; the audit is the string of these edits' initials. Among audits of least cost the
ASCII-least one is wanted, so the dynamic programme keeps whole audits: each state of the grammar holds the last
node of a linked list whose prefixes are shared. Two audits of one cost are compared at the end of their longest
common prefix, found over binary-lifting ancestors by rolling hashes; where hashes agree, letters are compared.

Neither of two audits of one cost for the same rows is a proper prefix of the other (equal letters on equal rows cost
the same, and what follows costs more), so that the least prefix of each state is enough.

Spark sorts each conversation's rows; a task reads them as a stream and holds none: each state has its own running
SHA-256, and what all surviving audits share is written down and forgotten. States that another one beats whatever
follows are dropped. Memory goes with the letters on which the surviving audits differ (some 250 bytes each); in the
worst case, such as a conversation of one role, that is all of them. The digest of a conversation is sequential,
which is why one task reads all its rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and role that a letter leads to from each state.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Initial that a row must have to be kept in each state, and where it leads.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: Nodes after which what is settled is looked for.
SETTLE_NODES = 1024

BLANK = r"[^\x20\x09-\x0D]"
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT_ARROW = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Trails:
    """Linked audits: a node is a letter after its parent's audit; node 0 is the empty audit."""

    def __init__(self) -> None:
        self.letters, self.depth, self.hash = bytearray(1), array("q", [0]), array("q", [0])
        #: Ancestors 1, 2, 4, ... letters up; those of a node begin at ``first``.
        self.first, self.up = array("q", [0]), array("q")

    def __len__(self) -> int:
        return len(self.letters)

    def parent(self, node: int) -> int:
        return self.up[self.first[node]]

    def add(self, parent: int, letter: str) -> int:
        depth = self.depth[parent] + 1
        self.first.append(len(self.up))
        self.up.append(parent)
        for k in range(depth.bit_length() - 1):
            parent = self.up[self.first[parent] + k]
            self.up.append(parent)
        node, parent = len(self.letters), self.up[self.first[-1]]
        self.letters.append(ord(letter))
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while (ahead := self.depth[node] - depth) > 0:
            node = self.up[self.first[node] + ahead.bit_length() - 1]
        return node

    def text(self, node: int, above: int = 0) -> str:
        """Letters of a node's audit below its ancestor ``above``."""
        out = []
        while node != above:
            out.append(self.letters[node])
            node = self.parent(node)
        return bytes(reversed(out)).decode()

    def _same(self, a: int, b: int) -> bool:
        """Whether two audits of one depth are equal: equal hashes are verified up to the node that both share."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letters[a] != self.letters[b]:
                return False
            a, b = self.parent(a), self.parent(b)
        return True

    def parting(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes at which two unequal audits of one depth differ: up in ever smaller steps while hashes do."""
        x, y = a, b
        for k in range(self.depth[a].bit_length() - 1, -1, -1):
            if self.depth[x] > 1 << k:
                up, other = self.up[self.first[x] + k], self.up[self.first[y] + k]
                if self.hash[up] != self.hash[other]:
                    x, y = up, other
        if self._same(self.parent(x), self.parent(y)) and self.letters[x] != self.letters[y]:
            return x, y
        # Two prefixes share a hash: letter by letter.
        x = y = 0
        while a != b:
            if self.letters[a] != self.letters[b]:
                x, y = a, b
            a, b = self.parent(a), self.parent(b)
        return x, y

    def less(self, a: int, more: str, b: int, other: str) -> bool:
        """Whether audit ``a`` and then ``more`` comes before audit ``b`` and then ``other`` in ASCII order."""
        if a == b:
            return more < other
        low = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, low), self.ancestor(b, low)
        if self._same(x, y):
            return self.text(a, x) + more < self.text(b, y) + other
        x, y = self.parting(x, y)
        return self.letters[x] < self.letters[y]


class _Way:
    """The best way to one state: its cost, the node of its audit, the running digest of its rows."""

    __slots__ = ("cost", "node", "digest")

    def __init__(self, cost: int, node: int, digest) -> None:
        self.cost, self.node, self.digest = cost, node, digest

    def lines(self, state: int, *parts: bytes):
        """The digest after one more row; only the first has no line end before it."""
        digest = self.digest.copy()
        for part in (b"" if state == START else b"\n", *parts):
            digest.update(part)
        return digest


class Repair:
    """The open repair of one conversation; rows come in order and are not held."""

    def __init__(self) -> None:
        self.trails, self.audit, self.wait = Trails(), [], SETTLE_NODES
        self.ways = {START: _Way(0, 0, hashlib.sha256())}

    def _before(self, cost: int, parent: int, letter: str, held: tuple | None) -> bool:
        return held is None or cost < held[0] or (cost == held[0] and self.trails.less(parent, letter, held[1], held[2]))

    def _inserted(self) -> dict[int, _Way]:
        """The ways with those that insertions open. Two in a row are as many as the grammar ever needs."""
        found = dict(self.ways)
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best, role = None, b"user:" if to == USER else b"assistant:"
            for state in sources:
                way = found.get(state)
                if way is not None and self._before(way.cost + INSERT_COST, way.node, INSERT, best):
                    best = (way.cost + INSERT_COST, way.node, INSERT, state)
            held = found.get(to)
            if best is not None and (held is None or best[0] < held.cost or (best[0] == held.cost and self.trails.less(best[1], INSERT, held.node, ""))):
                found[to] = _Way(best[0], self.trails.add(best[1], INSERT), found[best[3]].lines(best[3], role))
        return found

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        ways, best = self._inserted(), {}
        initial, more = role[:1], TRUNCATED_COST if truncated else 0
        for state, way in ways.items():
            edits = [(DELETE, state, DELETE_COST, None)]
            if not must_go:
                to, name = NEXT[state]
                edits.append((REROLE, to, REROLE_COST + more, name))
                if (state, initial) in KEPT:
                    edits.append((KEEP, KEPT[state, initial], more, role))
            for letter, to, price, name in edits:
                if self._before(way.cost + price, way.node, letter, best.get(to)):
                    best[to] = (way.cost + price, way.node, letter, state, name)
        if ASSISTANT in best:
            # From there all that follows START or SYSTEM can be had, for one deletion at most.
            least = best[ASSISTANT][0]
            best = {s: b for s, b in best.items() if b[0] <= least + {START: DELETE_COST, SYSTEM: 0}.get(s, INSERT_COST)}
        body = f":{text}".encode()
        self.ways = {}
        for to, (cost, parent, letter, state, name) in best.items():
            digest = ways[state].digest if name is None else ways[state].lines(state, name.encode(), body)
            self.ways[to] = _Way(cost, self.trails.add(parent, letter), digest)
        if len(self.trails) >= self.wait:
            self._settle()

    def _settle(self) -> None:
        """Write down what all ways share; the open ends go to new lists that share prefixes as before."""
        trails, nodes = self.trails, [w.node for w in self.ways.values()]
        shared = nodes[0]
        for node in nodes[1:]:
            low = min(trails.depth[shared], trails.depth[node])
            shared, node = trails.ancestor(shared, low), trails.ancestor(node, low)
            if not trails._same(shared, node):
                shared = trails.parent(trails.parting(shared, node)[0])
        self.audit.append(trails.text(shared))
        top, self.trails = trails.depth[shared], Trails()
        # Equal prefixes may be nodes of their own; they become one again.
        known: dict[tuple[int, str], int] = {}
        for way in self.ways.values():
            node = 0
            for letter in trails.text(way.node, trails.ancestor(way.node, top)):
                if (node, letter) not in known:
                    known[node, letter] = self.trails.add(node, letter)
                node = known[node, letter]
            way.node = node
        self.wait = max(SETTLE_NODES, 3 * len(self.trails))

    def end(self) -> tuple[int, str, str]:
        """Cost, audit, and hex SHA-256 of the repaired rows."""
        ways = self._inserted()
        final = [ways[s] for s in (START, ASSISTANT) if s in ways]
        best = final[0]
        for way in final[1:]:
            if way.cost < best.cost or (way.cost == best.cost and self.trails.less(way.node, "", best.node, "")):
                best = way
        return best.cost, "".join([*self.audit, self.trails.text(best.node)]), best.digest.hexdigest()


class _Conversation:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before[:1] + role[:1] not in LEGAL
        self.before = role
        if fault:
            self.faults[fault] += 1
        self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def out(self) -> dict:
        cost, audit, sha = self.repair.end()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``, the first of blank, duplicate and truncated that holds, or an empty string, and ``nth`` among equal rows.

    A duplicate has role and text of an earlier row of its conversation. One shuffle by conversation serves this
    window and the stream after it; rows with ``gone`` are no rows but keep their conversation alive.
    """
    near = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.repartition("conv_id").withColumn("nth", F.row_number().over(near)).withColumn("fault", fault)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation: counts of its faults, the cost and the audit of its repair, SHA-256 of the result.

    ``rows``: conv_id, turn, role, text, ``gone`` (true: no row, only the conversation counts). Rows go by turn (nulls
    first), then role and text. A null role or text counts as empty; a role whose initial isn't s, u or a can't be kept.
    Rows without a conv_id are one conversation. No rows: zeros, an empty audit, the digest of the empty string.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for batch in batches:
            for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.out())
                        size += len(out[-1]["audit"])
                    now = _Conversation(conv_id)
                if not gone:
                    now.row(turn, role, text, fault)
                if len(out) >= 5_000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT_ARROW)
                    out, size = [], 0
        if now is not None:
            out.append(now.out())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT_ARROW)

    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    ordered = with_faults(plain).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(stream, _OUT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known damage, by crc32 of ``conv_id:turn`` mod 20: 0 drops the row, 1 empties its text, 2 takes
    out its sentence ends, 3 repeats it, 4 makes its role ``user``. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (how == 0).alias("gone"), times.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(t ORDER BY i) AS entries
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
chosen AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(substr(key, j, 1)) AS BIGINT))),
    lambda c, b: xor(entries[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 20 AS how
  FROM keyed, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM chosen, range(2) copies(k) WHERE how <> 0 AND (k = 0 OR how = 3)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
),
gap(f, t, letters, price, lines) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'), (3, 2, 'I', 5, chr(10) || 'user:'),
    (2, 3, 'I', 5, chr(10) || 'assistant:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')
),
edit(f, t, letter, price, initial, role) AS (
  VALUES (0, 0, 'D', 2, '', ''), (1, 1, 'D', 2, '', ''), (2, 2, 'D', 2, '', ''), (3, 3, 'D', 2, '', ''),
    (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', ''), (3, 2, 'K', 0, 'u', ''),
    (0, 2, 'R', 1, '', 'user'), (1, 2, 'R', 1, '', 'user'), (2, 3, 'R', 1, '', 'assistant'), (3, 2, 'R', 1, '', 'user')
),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''} AS b FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT s.conv_id, r.i, e.t, min({'cost': s.b.cost + g.price + e.price + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': s.b.audit || g.letters || e.letter, 'body': s.b.body || g.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || e.role || ':' || r.text END})
  FROM best s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN gap g ON g.f = s.state JOIN edit e ON e.f = g.t
  WHERE e.letter = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR e.initial = substr(r.role, 1, 1)))
  GROUP BY s.conv_id, r.i, e.t
),
final AS (
  SELECT conv_id, min({'cost': b.cost + price, 'audit': b.audit || letters, 'body': b.body || lines}) AS f
  FROM best JOIN gap ON f = state AND t IN (0, 3) WHERE i = (SELECT coalesce(max(r.i), 0) FROM faulty r WHERE r.conv_id IS NOT DISTINCT FROM best.conv_id) GROUP BY conv_id
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT x.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  x.f.cost AS cost, x.f.audit AS audit, sha256(substr(x.f.body, 2)) AS repaired_sha256
FROM final x LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM x.conv_id
"""
