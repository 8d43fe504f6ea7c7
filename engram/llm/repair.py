"""Cheapest repair of conversations: an auction for shortest paths over a lattice of edits.

A conversation's lattice has a layer before each row and one after the last, and four nodes a layer: nothing said yet, last said by
the system, by the user, by the assistant. Arcs are edits with integer costs: K keeps a row, R gives it the role that is due, D
deletes it, I inserts an empty turn of the role that is due and stays in its layer. A conversation may end before anything is said
or after the assistant.

The auction keeps a path from the start and a price for each node. The path's last node is priced by its cheapest way on, arc and
price: if that is above its own price, the price rises and the path contracts by one node; if not, the path is extended along it.
When the path meets the end, the prices are an optimal dual: every arc of every cheapest path is tight. Tight arcs that lead to the
end are traced by the least edit letter.

A conversation is cut into segments of SEGMENT rows in the tasks of a range partitioning, so a hot one lies in many tasks. Where
there are more than one, each segment is summed up as costs between its four entry and four exit nodes, and auctions over FAN
segments at a time, up and down a tree, price the nodes between segments; 16 numbers a segment meet in one group, fewer bytes than
the audit that the contract returns in one cell. Texts are not held: the SHA-256 of a conversation is fed row by row.

Rules: null roles and texts are one space, null turns come first, a null conv_id is a conversation of its own; rows of one turn are
taken by role and by the digest of the text, so equal rows are adjacent. Roles beyond s, u, a can only be given a new role or be
deleted. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import crc_ctes, prepare, staged, table

SPACES = " \t\n\x0b\x0c\r"
SEGMENT, FAN = 64, 32
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
INF = math.inf
#: States: 0 nothing said, 1 after the system, 2 after the user, 3 after the assistant; the state after the turn that is due.
DUE = (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Costs of ending in each state.
ENDS = (0, INF, INF, 0)
Arcs = list[list[tuple[str, int, float]]]


def auction(arcs: Arcs, source: int, sink: int, prices: list[float]) -> None:
    """Raises prices, which must be at most arc cost + price of the arc's end for every arc, until the source's is its distance."""
    if prices[source] == INF:
        return
    path = [source]
    while path[-1] != sink:
        at = path[-1]
        best, to = min((cost + prices[j], j) for _, j, cost in arcs[at])
        if best > prices[at]:
            prices[at] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def _leading(arcs: Arcs, sink: int, good) -> set[int]:
    """Nodes from which arcs with good(node, to, cost) lead to the sink."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, j, cost in out:
            if good(i, j, cost):
                back[j].append(i)
    seen, todo = {sink}, [sink]
    while todo:
        for i in back[todo.pop()]:
            if i not in seen:
                seen.add(i)
                todo.append(i)
    return seen


def priced(arcs: Arcs, ends: tuple[float, ...]) -> tuple[Arcs, list[float]]:
    """The lattice with its sink, and the distance to it of each node on a cheapest path from one of the first four (others: infinite)."""
    sink = len(arcs)
    arcs = [list(x) for x in arcs] + [[]]
    for state, cost in enumerate(ends):
        if cost < INF:
            arcs[sink - 4 + state].append(("", sink, cost))
    can = _leading(arcs, sink, lambda i, j, cost: cost < INF)
    prices = [0.0 if i in can else INF for i in range(sink + 1)]
    for entry in range(4):
        auction(arcs, entry, sink, prices)
    tight = _leading(arcs, sink, lambda i, j, cost: prices[i] == cost + prices[j] < INF)
    return arcs, [p if i in tight else INF for i, p in enumerate(prices)]


def lattice(codes: str, last: bool) -> Arcs:
    """Arcs of a segment's rows: s, u, a, o by role initial, in capitals where truncated, x where a row has to be deleted."""
    arcs: Arcs = []
    for i in range(len(codes) + 1):
        for state in range(4):
            out: list[tuple[str, int, float]] = []
            if i < len(codes):
                code = codes[i]
                extra = code.isupper()
                out.append(("D", 4 * (i + 1) + state, COST["D"]))
                if code != "x":
                    if (code.lower(), state) in KEPT:
                        out.append(("K", 4 * (i + 1) + KEPT[code.lower(), state], COST["K"] + extra))
                    out.append(("R", 4 * (i + 1) + DUE[state], COST["R"] + extra))
            if i < len(codes) or last:
                out.append(("I", 4 * i + DUE[state], COST["I"]))
            arcs.append(out)
    return arcs


def chain(costs: list[list[list[float]]]) -> Arcs:
    """Arcs between the borders of consecutive segments, whose costs are given less each segment's least."""
    arcs: Arcs = [[] for _ in range(4 * (len(costs) + 1))]
    for k, c in enumerate(costs):
        for i in range(4):
            arcs[4 * k + i] = [("", 4 * (k + 1) + j, c[i][j]) for j in range(4) if c[i][j] < INF]
    return arcs


def between(arcs: Arcs) -> list[list[float]]:
    """Costs from each of the first four nodes to each of the last four."""
    unit = [[0 if i == j else INF for i in range(4)] for j in range(4)]
    columns = [priced(arcs, tuple(e))[1][:4] for e in unit]
    return [[columns[j][i] for j in range(4)] for i in range(4)]


@lru_cache(maxsize=50_000)
def segment_costs(codes: str, last: bool) -> tuple[tuple[float, ...], ...]:
    return tuple(map(tuple, between(lattice(codes, last))))


def _less(costs):
    least = min(min(row) for row in costs)
    return [[c - least for c in row] for row in costs]


def borders(costs: list, ends: tuple[float, ...]) -> list[tuple[float, ...]]:
    """What the rest costs beyond each segment, by exit state, less a constant; infinite off the cheapest paths."""
    costs = [_less(c) for c in costs]
    if len(costs) <= FAN:
        prices = priced(chain(costs), ends)[1]
        return [tuple(prices[4 * k : 4 * k + 4]) for k in range(1, len(costs))] + [ends]
    groups = [costs[i : i + FAN] for i in range(0, len(costs), FAN)]
    beyond = borders([between(chain(g)) for g in groups], ends)
    return [x for g, end in zip(groups, beyond, strict=True) for x in borders(g, end)]


@lru_cache(maxsize=50_000)
def traced(codes: str, ends: tuple[float, ...], last: bool) -> tuple[tuple[str, int] | None, ...]:
    """For each entry state the least tight edits through a segment and the state they end in."""
    arcs, prices = priced(lattice(codes, last), ends)
    sink, out = len(arcs) - 1, []
    for at in range(4):
        if prices[at] == INF:
            out.append(None)
            continue
        said = []
        while True:
            label, to, _ = min(a for a in arcs[at] if prices[at] == a[2] + prices[a[1]] < INF)
            if to == sink:
                break
            said.append(label)
            at = to
        out.append(("".join(said), at % 4))
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows dropped (no copies), emptied, without stops, repeated or by the user, by CRC-32."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _rows(conversations: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in conversations.columns else F.lit(1)
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), copies.alias("copies"))
    return t.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


SEGMENTS = "conv_id long, turn long, role string, digest binary, part long, follows boolean, codes string, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
LEGAL = {"su", "ua", "au"}


def _segments(rows: DataFrame) -> DataFrame:
    """Segments of conversations, in the order of (turn, role, digest, part); texts stay behind."""
    last = F.substring(_trimmed(F.col("text")), -1, 1)
    t = rows.select("conv_id", "turn", "role", "digest", "copies", (F.length(last) == 0).alias("is_blank"), (~last.isin(".", "!", "?")).alias("cut"))
    seen = t.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("s"))
    t = t.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    t = t.select("conv_id", "turn", "role", "digest", "copies", "is_blank", "cut", (~F.col("turn").eqNullSafe(F.col("s.turn"))).alias("again"))
    order = ["conv_id", "turn", "role", "digest"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches):
        out: list[dict] = []
        now, before, conv, part = None, None, None, 0  # before: the row before in the conversation

        def new(row, follows):
            return {"conv_id": row[0], "turn": row[1], "role": row[2], "digest": row[3], "part": part, "follows": follows, "codes": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_initial": None, "last_initial": None, "first_turn": None, "last_turn": None, "turns": 0}

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or row[0] != conv:
                    if now is not None:
                        out.append(now)
                    conv, part, before = row[0], 0, None
                    now = new(row, False)
                _, turn, role, digest, copies, is_blank, cut, again = row
                for _ in range(copies):
                    if len(now["codes"]) == SEGMENT:
                        out.append(now)
                        part += 1
                        tail = now
                        now = new(row, True)
                        now["last_initial"], now["last_turn"] = tail["last_initial"], tail["last_turn"]
                    initial = role[:1]
                    if now["last_initial"] is not None:
                        now["illegal"] += now["last_initial"] + initial not in LEGAL
                    elif now["first_initial"] is None:
                        now["first_initial"] = initial
                    now["last_initial"] = initial
                    if turn is not None and turn != now["last_turn"]:
                        now["turns"] += 1
                        now["last_turn"] = turn
                        if now["first_turn"] is None:
                            now["first_turn"] = turn
                    duplicate = again or before == (turn, digest)
                    before = (turn, digest)
                    if is_blank or duplicate:
                        now["blank" if is_blank else "duplicate"] += 1
                        now["codes"].append("x")
                    else:
                        code = initial if initial in ("s", "u", "a") else "o"
                        now["truncated"] += cut
                        now["codes"].append(code.upper() if cut else code)
            if len(out) > 5000:
                yield batch(out)
                out.clear()
        if now is not None:
            out.append(now)
        yield batch(out)

    def batch(rows):
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        for r in rows:
            r["codes"] = "".join(r["codes"])
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[x.split()[1]]) for n, x in zip(names, SEGMENTS.split(", "), strict=True)], names)

    return t.mapInArrow(run, SEGMENTS)


ORDER = ("turn", "role", "digest", "part")


def _place(r) -> tuple:
    return (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["digest"], r["part"])


def _edits(segments: DataFrame) -> DataFrame:
    """Segments with `paths`: for each entry state the edits, the exit state and the cost."""
    many = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    many = staged(many, "long_conversations")
    on = F.col("conv_id").eqNullSafe(F.col("c"))
    lone = segments.join(many, on, "left_anti").select("*", F.lit(None).cast("array<double>").alias("ends"), F.lit(True).alias("last"))
    parts = segments.join(many, on, "left_semi")

    def cost(batches):
        for b in batches:
            found = [[c for row in segment_costs(x, False) for c in row] for x in b.column(5).to_pylist()]
            final = [[c for row in segment_costs(x, True) for c in row] for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found, pa.list_(pa.float64())), pa.array(final, pa.list_(pa.float64()))], ["conv_id", *ORDER, "costs", "final"])

    key = "conv_id long, turn long, role string, digest binary, part long"
    costs = parts.select("conv_id", *ORDER, "codes").mapInArrow(cost, f"{key}, costs array<double>, final array<double>")

    def price(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=_place)
        square = lambda x: [x[4 * i : 4 * i + 4] for i in range(4)]
        ends = borders([square(r["costs"]) for r in rows[:-1]] + [square(rows[-1]["final"])], ENDS)
        return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "turn": pa.array([r["turn"] for r in rows], pa.int64()), "role": pa.array([r["role"] for r in rows], pa.string()), "digest": pa.array([r["digest"] for r in rows], pa.binary()), "part": pa.array([r["part"] for r in rows], pa.int64()), "ends": pa.array([list(e) for e in ends], pa.list_(pa.float64())), "last": pa.array([k == len(rows) - 1 for k in range(len(rows))])})

    ends = costs.groupBy("conv_id").applyInArrow(price, f"{key}, ends array<double>, last boolean")
    ends = ends.select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", *ORDER)], "ends", "last")
    same = F.lit(True)
    for c in ("conv_id", *ORDER):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    both = lone.unionByName(parts.join(ends, same).select(*segments.columns, "ends", "last"))

    def trace(batches):
        for b in batches:
            found = []
            for codes, ends, last in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), b.column("last").to_pylist(), strict=True):
                found.append([{"edits": p[0], "exit": p[1]} if p else None for p in traced(codes, tuple(ends) if ends else ENDS, last)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.struct([("edits", pa.string()), ("exit", pa.int32())])))], [*b.schema.names, "paths"])

    schema = f"{SEGMENTS}, ends array<double>, last boolean, paths array<struct<edits string, exit int>>"
    return both.select(*segments.columns, "ends", "last").mapInArrow(trace, schema)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


class _Conversation:
    """One conversation of the last pass: its segments, then its rows."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.edits, self.at = conv_id, 0, [], 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.initial = self.low = self.high = None
        self.turns = self.cost = self.place = self.said = 0
        self.codes: list[str] = []
        self.sha, self.audit = hashlib.sha256(), None

    def segment(self, s) -> None:
        for c in self.counts:
            self.counts[c] += s[c]
        if not s["follows"] and self.initial is not None and s["first_initial"] is not None:
            self.counts["illegal"] += self.initial + s["first_initial"] not in LEGAL
        self.initial = self.initial if s["last_initial"] is None else s["last_initial"]
        if s["turns"]:
            self.turns += s["turns"] - (not s["follows"] and s["first_turn"] == self.high)
            self.low = s["first_turn"] if self.low is None else self.low
            self.high = s["last_turn"]
        path = s["paths"][self.state]
        self.edits.append(path["edits"])
        self.codes.append(s["codes"])
        self.state = path["exit"]

    def start(self) -> None:
        self.audit, codes, at = "".join(self.edits), "".join(self.codes), 0
        for e in self.audit:
            self.cost += COST[e]
            if e != "I":
                self.cost += e != "D" and codes[at].isupper()
                at += 1
        self.edits, self.codes, self.state = [], [], 0

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
            yield self._say("K", role, text)
        elif edit == "R":
            yield self._say("R", self._due(), text)

    def finish(self):
        if self.audit is None:
            self.start()
        yield from self._inserted()

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._say("I", self._due(), "")

    def _due(self) -> str:
        self.state = DUE[self.state]
        return "user" if self.state == 2 else "assistant"

    def _say(self, edit, role, text):
        self.sha.update((("\n" if self.said else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.said += 1
        return (self.conv_id, self.said - 1, edit, role, text)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.sha.hexdigest())


def _last_pass(conversations: DataFrame, report: bool) -> DataFrame:
    prepare(conversations.sparkSession)
    rows = _rows(conversations)
    segments = staged(_segments(rows), "segments")
    stats = [x.split()[0] for x in SEGMENTS.split(", ")][4:]
    head = _edits(segments).select("conv_id", F.lit(0).alias("kind"), "turn", "role", "digest", "part", F.lit(None).cast("string").alias("text"), F.lit(1).alias("copies"), F.struct(*stats, "paths").alias("s"))
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.lit(0).cast("long").alias("part"), "text", "copies", F.lit(None).cast(head.schema["s"].dataType).alias("s"))
    both = head.unionByName(body)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    schema = REPORT if report else REPAIRED
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def run(batches):
        out, now = [], None

        def end():
            said = list(now.finish())
            out.extend([now.report()] if report else said)

        for b in batches:
            for small in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                for r in small.to_pylist():
                    if now is None or now.conv_id != r["conv_id"]:
                        if now is not None:
                            end()
                        now = _Conversation(r["conv_id"])
                    if r["kind"] == 0:
                        now.segment(r["s"])
                        continue
                    if now.audit is None:
                        now.start()
                    for _ in range(r["copies"]):
                        for said in now.row(r["role"], r["text"]):
                            if not report:
                                out.append(said)
                if len(out) >= 512:
                    yield batch(out)
                    out.clear()
        if now is not None:
            end()
        yield batch(out)

    def batch(found):
        kinds = {"long": pa.int64(), "string": pa.string()}
        columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))

    return both.mapInArrow(run, schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text, a row for each conversation. A column `copies`, where there is one, says how often a row stands."""
    return _last_pass(conversations, True)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations (place from 0)."""
    return _last_pass(conversations, False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation of `conversations` after damage by rule."""
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


OP11_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
{crc_ctes("SELECT DISTINCT s FROM t")},
damaged AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies FROM t JOIN crc32 USING (s)),
after AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS n
    FROM damaged, range(2) c(copy) WHERE copy < copies),
found AS (SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM after),
r AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM found),
counts AS (SELECT c.conv_id, count(n) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
inserts(q, ins, via) AS (VALUES ('0', '', '0'), ('0', 'I', 'u'), ('0', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')),
edits(via, e, target, cost, role) AS (VALUES ('0', 'D', '0', 3, ''), ('s', 'D', 's', 3, ''), ('u', 'D', 'u', 3, ''), ('a', 'D', 'a', 3, ''), ('0', 'K', 's', 0, 's'), ('0', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'),
    ('0', 'R', 'u', 2, ''), ('s', 'R', 'u', 2, ''), ('u', 'R', 'a', 2, ''), ('a', 'R', 'u', 2, '')),
ends(q, cost, audit) AS (VALUES ('0', 0, ''), ('a', 0, ''), ('u', 2, 'I'), ('s', 4, 'II')),
dp(conv_id, n, q, best) AS (SELECT conv_id, m + 1, q, {{'cost': cost, 'audit': audit}} FROM counts, ends
    UNION ALL SELECT dp.conv_id, dp.n - 1, i.q, min({{'cost': dp.best.cost + e.cost + 2 * CAST(length(ins) AS INTEGER) + CASE WHEN cut AND e <> 'D' THEN 1 ELSE 0 END, 'audit': ins || e || dp.best.audit}})
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n - 1 JOIN edits e ON e.target = dp.q AND (e = 'D' OR NOT (blank OR duplicate)) AND (e <> 'K' OR e.role = initial) JOIN inserts i ON i.via = e.via GROUP BY ALL),
best AS (SELECT conv_id, best.cost AS cost, best.audit AS audit FROM dp WHERE n = 1 AND q = '0'),
steps AS (SELECT conv_id, k, substr(audit, k, 1) AS e FROM best, range(1, 100000) x(k) WHERE k <= length(audit)),
placed AS (SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER w AS at, count(*) FILTER (e <> 'D') OVER w AS j FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT p.conv_id, k, e, j, r.role, r.text, max(CASE WHEN j = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.at WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text FROM said GROUP BY conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM counts c JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id"""
