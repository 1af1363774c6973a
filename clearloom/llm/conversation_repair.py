"""Repair of conversation structure by cost layers: from the last turn to the first, a bitset for each cost holds the grammar states that can still reach an accepting end at that cost; the first layer that holds the start gives the cost, and the bits are traced forward for the least audit.

Edits: Keep (K, 0), Rerole to user or assistant (R, 3), Delete (D, 4; the only edit of blank and repeated turns), Insert an empty user or assistant turn (I, 3); a truncated turn that stays costs 3 more. The repaired role initials are `(s?(ua)+)?`. Of the cheapest audits the ASCII-least is taken; it fixes the roles, as each state can write one role only.

From each state each other one is reached by two inserts and one deletion at most, so of one turn's layers few differ; they are held relative to the first that isn't empty, and steps between such layer stacks are worked out once (StackSteps).

Order: turns by `turn` (nulls first); ties by role, by the first 32 characters of the text, then by SHA-256 of the text. Sorting is global, so a conversation with very many turns is spread over tasks; it moves on as blocks of up to BLOCK turns with a byte for each. What has to be in one place is what the result demands there: a conversation's audit (a byte for each turn and for each edit) and the running SHA-256, through which repaired turns stream one by one. Repeated turns are found by SHA-256 of role and text.

Nulls: a null role or text is one space; turns with a null conv_id are one conversation. Empty and white texts are blank; very long texts are processed whole, and stay out of the layers. A role that doesn't begin with s, u or a can't be kept. Repeated rows are duplicates of the first. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table

#: Turns of one conversation that move together; a power of two.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = r"[\x20\x09-\x0D]"
#: Kinds of turns: initial of the role (0 s, 1 u, 2 a, 3 another) + 4 x fault.
GOOD, BLANK, REPEATED, CUT = 0, 1, 2, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Keeping an initial goes from a state to another, or nowhere (-1).
KEPT = {0: (1, -1, -1, -1), 1: (2, 2, -1, 2), 2: (-1, -1, 3, -1), 3: (-1, -1, -1, -1)}
WRITTEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ACCEPT = 0b1001
ALL = 0b1111


def _before(moves: tuple[int, ...]) -> list[int]:
    """For each bitset of states, the bitset of those that a move takes into it."""
    return [sum(1 << q for q, to in enumerate(moves) if to >= 0 and s >> to & 1) for s in range(16)]


BEFORE_KEEP = {k: _before(v) for k, v in KEPT.items()}
BEFORE_WRITE = _before(WRITTEN)


class StackSteps:
    """Stacks of layers: stack[c] holds the states with an end at cost c or less (above the stack's base); the last layer holds all. step() puts a turn in front."""

    def __init__(self):
        self.stacks: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.levels: list[tuple[int, ...]] = []
        self.end, _ = self._add(self._layers(lambda c, new: ACCEPT if c == 0 else 0))

    def _layers(self, came) -> list[int]:
        """came(c, layers so far): states that get to cost c by an edit of the turn; inserts and cheaper layers are added here."""
        new: list[int] = []
        while not new or new[-1] != ALL:
            c = len(new)
            s = came(c, new) | (new[-1] if new else 0)
            if c >= INSERT:
                s |= BEFORE_WRITE[new[c - INSERT]]
            new.append(s)
        return new

    def _add(self, layers: list[int]) -> tuple[int, int]:
        shift = next(i for i, s in enumerate(layers) if s)
        key = tuple(layers[shift:])
        if key not in self.ids:
            self.ids[key] = len(self.stacks)
            self.stacks.append(key)
            self.levels.append(tuple(next(c for c, s in enumerate(key) if s >> q & 1) for q in range(4)))
        return self.ids[key], shift

    def step(self, stack: int, code: int) -> tuple[int, int]:
        """(stack with the turn in front, how much its base is above the other's)."""
        found = self.steps.get((stack, code))
        if found is None:
            old, keep, fault = self.stacks[stack], BEFORE_KEEP[code & 3], code >> 2
            at = lambda c: 0 if c < 0 else old[min(c, len(old) - 1)]
            more = TRUNCATED if fault == CUT else 0

            def came(c: int, new: list[int]) -> int:
                s = at(c - DELETE)
                if fault not in (BLANK, REPEATED):
                    s |= keep[at(c - KEEP - more)] | BEFORE_WRITE[at(c - REROLE - more)]
                return s

            found = self.steps[stack, code] = self._add(self._layers(came))
        return found


def least_edits(codes: bytes, steps: StackSteps) -> tuple[int, str]:
    """(cost, audit) of a conversation given by the kinds of its turns."""
    n = len(codes)
    stack, shift = array("H", bytes(2 * (n + 1))), array("B", bytes(n + 1))
    stack[n] = steps.end
    for i in range(n - 1, -1, -1):
        stack[i], shift[i] = steps.step(stack[i + 1], codes[i])
    levels, audit, state, i = steps.levels, [], 0, 0
    cost = sum(shift) + levels[stack[0]][0]
    while True:
        here = levels[stack[i]][state]  # cost to an end, above this turn's base
        if i < n:
            fault, after = codes[i] >> 2, levels[stack[i + 1]]
            here_next = here + shift[i]  # the same, above the next turn's base
            if DELETE + after[state] == here_next:
                audit.append("D")
                i += 1
                continue
        elif here == 0 and ACCEPT >> state & 1:
            return cost, "".join(audit)
        if INSERT + levels[stack[i]][WRITTEN[state]] == here:
            audit.append("I")
            state = WRITTEN[state]
            continue
        more = TRUNCATED if fault == CUT else 0
        kept = KEPT[codes[i] & 3][state]
        if kept >= 0 and KEEP + more + after[kept] == here_next:
            audit.append("K")
            state = kept
        else:
            audit.append("R")
            state = WRITTEN[state]
        i += 1


def role_after(edits: str, codes: bytes) -> Iterator[tuple[int, str, str | None]]:
    """(turn, edit, role that the edit writes) of an audit; inserts carry the turn that they come before."""
    state = i = 0
    for e in edits:
        if e == "K":
            state = KEPT[codes[i] & 3][state]
        elif e != "D":
            state = WRITTEN[state]
        yield i, e, ROLES[state] if e in "RI" else None
        i += e != "I"


def illegal_pairs(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and pos (places rise through all conversations), written to the shared folder."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(997)))  # equal rows may go to several tasks
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 32), "digest", "__salt"]
    return stage(rows.orderBy(*keys).drop("__salt").withColumn("pos", F.monotonically_increasing_id()), "conversations")


def kinds(turns: DataFrame) -> DataFrame:
    """conv_id, turn, pos, code of each turn."""
    text, first = F.col("text"), F.substring("role", 1, 1)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(rf"[.!?]{WHITE}*\z")
    light = turns.select("conv_id", "turn", "pos", "digest", F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    firsts = light.filter(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED).when(F.col("cut"), CUT).otherwise(GOOD)
    return light.join(firsts, "pos", "left").select("conv_id", "turn", "pos", (F.col("initial") + 4 * fault).cast("byte").alias("code"))


def blocks(coded: DataFrame) -> DataFrame:
    """conv_id, first (its first pos), codes: up to BLOCK neighbouring turns of a conversation, which have neighbouring places."""
    got = coded.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("turns"))
    return got.select("conv_id", F.col("turns")[0]["pos"].alias("first"), F.col("turns.code").alias("codes"))


def solved(coded: DataFrame) -> DataFrame:
    """A row for each conversation (edit null): blank, duplicate, truncated, illegal, cost, audit; and one for each edit: pos, sub (order at a place), edit, role (if the edit writes one)."""
    rows = blocks(coded)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    kinds_of = (("pos", "long"), ("sub", "int"), ("edit", "string"), ("role", "string"), *((c, "long") for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kinds_of)
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def one(conv_id, parts: list[tuple[int, bytes]], steps: StackSteps) -> Iterator[dict]:
        codes = b"".join(c for _, c in parts)
        cost, audit = least_edits(codes, steps)
        faults = [sum(codes.count(4 * f + k) for k in range(4)) for f in (BLANK, REPEATED, CUT)]
        yield {"conv_id": conv_id, "blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": illegal_pairs(codes), "cost": cost, "audit": audit}
        places = (first + i for first, c in parts for i in range(len(c)))
        pos, at, sub = next(places), 0, 0
        for i, e, role in role_after(audit, codes):
            if i != at:
                at, sub, pos = i, 0, next(places, pos + 1)  # after the last turn: one place on
            yield {"conv_id": conv_id, "pos": pos, "sub": sub, "edit": e, "role": role}
            sub += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, out, now, parts, names = StackSteps(), [], None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if parts:
                for row in one(now[0], parts, steps):
                    out.append(row)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_pylist(out, names)
                        out.clear()

        for batch in batches:
            names = pa.schema([batch.schema.field(0), *((c, arrow[t]) for c, t in kinds_of)])
            for conv_id, first, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    yield from ended()
                    now, parts = (conv_id,), []
                parts.append((first, bytes(codes)))
        yield from ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, names)

    return stage(rows.mapInArrow(lean(run), schema), "conversation-edits")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, edits, repaired) of conversations (conv_id, turn, role, text).

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. edits: conv_id, pos, sub, edit, role. repaired: conv_id, pos, sub (their order), edit, role, text of the turns that are left.
    """
    turns = ordered(rows)
    coded = kinds(turns)
    found = solved(coded)
    whole = lambda c: c.cast("decimal(38,0)")
    by_turn = coded.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("turn").alias("k"))
    gaps = by_turn.select("conv_id", F.when(F.col("k") > 0, (whole(F.col("b")) - whole(F.col("a")) + 1 - F.col("k")).try_cast("long")).otherwise(0).alias("gaps"))
    counts = found.filter(F.col("edit").isNull()).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    summary = gaps.unionByName(counts, allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")))
    edits = found.filter(F.col("edit").isNotNull()).select("conv_id", "pos", "sub", "edit", "role")
    left = edits.filter(F.col("edit") != "D")
    own = turns.select("pos", F.col("role").alias("own_role"), "text")
    kept = left.filter(F.col("edit") != "I").join(own, "pos")
    fresh = left.filter(F.col("edit") == "I").select("*", F.lit("").alias("text"))
    repaired = kept.withColumn("role", F.coalesce("role", "own_role")).drop("own_role").unionByName(fresh).select("conv_id", "pos", "sub", "edit", "role", "text")
    return summary, edits, repaired


def repaired_sha256(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` of the turns in order, joined by newlines. Turns stream through one hash for each conversation."""
    rows = repaired.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            ids, digests = [], []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(3)):
                data = line.as_buffer()
                if now is not None and now[0] == conv_id:
                    sha.update(b"\n")
                else:
                    if now is not None:
                        ids.append(now[0])
                        digests.append(sha.hexdigest())
                    now, sha = (conv_id,), hashlib.sha256()
                sha.update(data)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.schema.field(0).type), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(lean(run), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that the contract plants."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("__fault"))
    fault: Column = F.col("__fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    summary, _, repaired = repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    parts = every.unionByName(summary, allowMissingColumns=True).unionByName(repaired_sha256(repaired), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    best = lambda c, none: F.coalesce(F.max(c), F.lit(none)).alias(c)
    out = parts.groupBy("conv_id").agg(*(best(c, 0) for c in numbers), best("audit", ""), best("repaired_sha256", hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", *(F.col(c).cast("long").alias(c) for c in numbers), "audit", "repaired_sha256")


_CRC = """crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"""

ORACLE = f"""
WITH RECURSIVE {_CRC},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
        FROM (SELECT DISTINCT k FROM keyed), crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM keyed JOIN crc USING (k) WHERE d <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
marked AS (SELECT conv_id, turn, role, text, i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS c, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c2 FROM numbered),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS f FROM marked),
least AS (
  SELECT coalesce(conv_id, -1) AS cid, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, '00000003I' AS s2, '00000006II' AS s3 FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT cid, i, s0, s1, least(s2, upd(s0, 3, 'I'), upd(s1, 3, 'I'), upd(s3, 3, 'I')) AS s2, least(s3, upd(s0, 6, 'II'), upd(s1, 6, 'II'), upd(s2, 3, 'I')) AS s3
  FROM (SELECT l.cid, r.i,
      upd(s0, 4, 'D') AS s0,
      least(upd(s1, 4, 'D'), CASE WHEN r.f IN (0, 3) AND r.c = 's' THEN upd(s0, r.f, 'K') END) AS s1,
      least(upd(s2, 4, 'D'), CASE WHEN r.f IN (0, 3) AND r.c = 'u' THEN least(upd(s0, r.f, 'K'), upd(s1, r.f, 'K'), upd(s3, r.f, 'K')) END, CASE WHEN r.f IN (0, 3) THEN least(upd(s0, r.f + 3, 'R'), upd(s1, r.f + 3, 'R'), upd(s3, r.f + 3, 'R')) END) AS s2,
      least(upd(s3, 4, 'D'), CASE WHEN r.f IN (0, 3) AND r.c = 'a' THEN upd(s2, r.f, 'K') END, CASE WHEN r.f IN (0, 3) THEN upd(s2, r.f + 3, 'R') END) AS s3
    FROM least l JOIN faults r ON l.cid = coalesce(r.conv_id, -1) AND r.i = l.i + 1)
)
""".replace("upd(", "UPD(")


def _expand(sql: str) -> str:
    """Writes out UPD(state, cost, edit): a state is its cost in eight digits and its audit, so that the least string is the best."""
    import re

    while m := re.search(r"UPD\((\w+), ([^,()]+), '(\w+)'\)", sql):
        s, cost, edit = m.groups()
        sql = sql[: m.start()] + f"(lpad((left({s}, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({s}, 9) || '{edit}')" + sql[m.end() :]
    return sql


ORACLE = _expand(ORACLE).rstrip() + """,
done AS (SELECT cid, least(s0, s3) AS s, row_number() OVER (PARTITION BY cid ORDER BY i DESC) AS r FROM least),
audits AS (SELECT cid, left(s, 8)::BIGINT AS cost, substr(s, 9) AS audit FROM done WHERE r = 1),
edits AS (SELECT cid, unnest(range(1, length(audit) + 1)) AS k, audit FROM audits),
edit AS (SELECT cid, k, substr(audit, k, 1) AS e, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS place FROM edits),
taken AS (SELECT e.cid, e.k, e.e, e.place, f.role, f.text FROM edit e LEFT JOIN faults f ON e.cid = coalesce(f.conv_id, -1) AND e.i = f.i AND e.e <> 'I' WHERE e.e <> 'D'),
headed AS (SELECT *, bool_or(place = 1 AND e = 'K' AND left(role, 1) = 's') OVER (PARTITION BY cid) AS sys FROM taken),
lines AS (SELECT cid, k, CASE WHEN e = 'K' THEN role WHEN (place + CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM headed),
shas AS (SELECT cid, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY cid),
counts AS (SELECT coalesce(conv_id, -1) AS cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 1) AS blank, count_if(f = 2) AS duplicate, count_if(f = 3) AS truncated, count_if(c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
  coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON coalesce(o.conv_id, -1) = c.cid LEFT JOIN audits a ON coalesce(o.conv_id, -1) = a.cid LEFT JOIN shas s ON coalesce(o.conv_id, -1) = s.cid
"""
